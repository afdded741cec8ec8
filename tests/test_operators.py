from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import anchored, chains, dead_letters, handlers, lanes, metrics, routing
from tidelane.operators.alerts import Alerts, log_alerts
from tidelane.operators.subscribe import Subscriptions, fan_out


@pytest.mark.parametrize(("client", "table", "want", "lane"), [
    (0, None, 2, "TRANSACTIONAL"), (1, None, 2, "TRANSACTIONAL"), (3, None, 3, "REALTIME"), (0, 0, 0, "BATCH"), (1, 0, 1, "TRANSACTIONAL"), (0, 1, 1, "TRANSACTIONAL"), (1, 4, 4, "REALTIME"), (4, 2, 4, "REALTIME"),
])
def test_effective_priority(spark, client, table, want, lane):
    df = spark.createDataFrame([(client, "t")], "priority int, topic string")
    topics = spark.createDataFrame([("t", table)] if table is not None else [], "topic string, priority int")
    r = routing.route(df, topics).first()
    assert (r.effective_priority, r.lane) == (want, lane)


CASES = [
    (
        "sensor/temperature", b"", "DROP", "empty body for temperature sensor", None
    ), (
        "sensor/temperature/room1", [80], "SUCCESS", None, None
    ), ("sensor/temperature", [81], "ALERT", None, 1), ("sensor/temperature", [100], "ALERT", None, 1),
    ("sensor/temperature", [101], "ALERT", None, 2), ("sensor/temperature", [150], "ALERT", None, 2), (
        "sensor/temperature", [151], "DROP", "temperature out of physical range", None
    ), ("sensor/pressure", [150], "SUCCESS", None, None),
    ("sensor/pressure", [151], "ALERT", None, 1), ("sensor/pressure", [200], "ALERT", None, 1), ("sensor/pressure", [201], "ALERT", None, 3), (
        "payment", [1, 2, 3], "DROP", "payment body too short", None
    ),
    (
        "payment/card", [0, 0, 0, 0], "DROP", "payment amount is zero", None
    ), ("payments.x", [1, 0, 0, 0], "SUCCESS", None, None), ("payment", (1_000_000).to_bytes(4, "little"), "SUCCESS", None, None),
    (
        "payment", (1_000_001).to_bytes(4, "little"), "DROP", "payment amount exceeds limit", None
    ), ("audit", b"", "DROP", "empty audit log body", None), ("state/a", b"", "SUCCESS", None, None), ("", b"x", "DROP", "empty topic", None),
]


def test_handlers(spark):
    df = spark.createDataFrame([(i, t, bytes(b)) for i, (t, b, *_) in enumerate(CASES)], "id int, topic string, body binary")
    got = {r.id: (r.outcome, r.reason, r.alert_level) for r in handlers.handle(df, handlers.default_registry()).collect()}
    assert got == {i: tuple(c[2:]) for i, c in enumerate(CASES)}


def test_longest_prefix_and_empty_prefix(spark):
    named = lambda n: handlers.Handler(n)
    registry = handlers.Registry().register("a", named("A")).register("a/b", named("AB")).register("", named("none"))
    df = spark.createDataFrame([("a/b/c",), ("a/x",), ("",), ("z",)], "topic string")
    got = [r.h for r in df.select(registry.choose(lambda h: F.lit(h.name)).alias("h")).collect()]
    assert got == ["AB", "A", "none", "DefaultEventHandler"]


def test_anchored_windows_by_hand():
    number, anchor, last = anchored.anchored_numbers(np.array([0, 30, 50, 70, 90, 105]), 50)
    assert number.tolist() == [0, 0, 0, 1, 1, 1] and (anchor, last) == (105, 2)
    assert anchored.anchored_numbers(np.array([0, 50]), 50)[0].tolist() == [0, 0]


def test_anchored_windows_in_parts_equal_the_whole():
    t = np.sort(np.random.default_rng(1).integers(0, 10_000, 500))
    whole, anchor, number = anchored.anchored_numbers(t, 300)
    first, a, n = anchored.anchored_numbers(t[:217], 300)
    second, a, n = anchored.anchored_numbers(t[217:], 300, a, n)
    assert np.concatenate([first, second]).tolist() == whole.tolist() and (a, n) == (anchor, number)


def test_duplicates_by_hand():
    hour = 3_600_000
    assert anchored.dedup_status(np.array([0, hour, hour + 1]), np.array([True] * 3), hour)[0] == ["processed", "duplicate", "processed"]
    assert anchored.dedup_status(np.array([0, 1]), np.array([False, True]), hour)[0] == ["failed", "processed"]


def test_lazy_cleanup_keeps_expired_entries_until_it_runs(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 2, 5), (1, 3, 105), (3, 4, 120), (1, 5, 121)], "k long, id long, t long")
    got = {r.id: r.status for r in anchored.lazy_dedup(df, "k", "t", "id", F.lit(True), 100, 10).collect()}
    assert got == {1: "processed", 2: "processed", 3: "duplicate", 4: "processed", 5: "processed"}


def lazily(rows, ttl, every):
    """rows (key, id, time, ok) with their status, one after the other as the lazy mode is described."""
    last = lambda value: (value is None, value or 0)
    seen, cleaned, out = {}, None, []
    for k, i, t, ok in sorted(rows, key=lambda r: (last(r[2]), last(r[1]), last(r[0]), not r[3])):
        if k in seen:
            out.append((k, i, t, "duplicate"))
            continue
        if t is not None and (cleaned is None or t - cleaned >= every):
            seen, cleaned = {x: s for x, s in seen.items() if t - s <= ttl}, t
        out.append((k, i, t, "processed" if ok else "failed"))
        if ok and k is not None:
            seen[k] = t
    return out


@pytest.mark.parametrize(("keys", "ttl", "every"), [(40, 100, 30), (400, 300, 7), (4, 0, 1), (900, 5000, 1000)])
def test_lazy_dedup_equals_one_event_after_the_other(spark, keys, ttl, every):
    """Over blocks of 64 events, with ties, copies, missing keys, ids and times, and keys that doubles can't hold."""
    r = np.random.default_rng(keys)
    some = lambda value: None if r.random() < 0.01 else int(value)
    rows = [(some(2**53 + r.integers(keys)), some(r.integers(5)), some(r.integers(6000)), [True, True, False, None][r.integers(4)]) for _ in range(2500)]
    rows += [rows[i] for i in r.integers(0, len(rows), 300)]
    rows += [(k, i, t, not ok) for k, i, t, ok in rows[:100]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        df = spark.createDataFrame(rows, "k long, i long, t long, ok boolean").repartition(3)
        got = [tuple(x) for x in anchored.lazy_dedup(df, "k", "t", "i", F.col("ok"), ttl, every).select("key", "id", "time", "status").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lazily(rows, ttl, every)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({s for *_, s in want}) == 3


def test_lazy_dedup_brings_no_task_all_events(spark):
    store, doubles, n = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0), 50_000
    listed = lambda x: [x.apply(i) for i in range(x.size())]
    stages = lambda: {s.stageId(): s.attemptId() for s in listed(store.stageList(None, False, False, doubles, None))}
    before = stages()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(n).select((F.col("id") % 50).alias("k"), "id", (F.col("id") * 7).alias("t"))
        assert anchored.lazy_dedup(df, "k", "t", "id", F.lit(True), 1000, 10).where("status = 'processed'").count() == 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = [t for s, attempt in stages().items() if s not in before for t in listed(store.taskList(s, attempt, 1000))]
    read = [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined()]
    assert sum(read) >= n and max(read) < n / 2


def test_last_times_of_many_keys():
    r, seen, want = np.random.default_rng(3), anchored.LastTimes(), {}
    for t in range(0, 60, 10):
        keys = np.unique(r.integers(-(10**12), 10**12, 9000))
        keys = np.union1d(keys, r.choice(np.array([*want, 5]), 500))
        times = np.full(len(keys), t)
        seen.set(keys, times, t - 20)
        want |= dict(zip(keys.tolist(), times.tolist(), strict=True))
        known = np.array([k for k, at in want.items() if at >= t - 20])
        assert seen.of(known).tolist() == [want[k] for k in known.tolist()]
        assert (seen.of(keys + 1)[~np.isin(keys + 1, known)] == anchored.NEVER).all()
    assert len(seen.keys) + len(seen.recent) < len(want)


@pytest.mark.parametrize(
    ("policy", "capacity", "kept"),
    [
        ("DROP_OLD", 16_384, range(33_617, 50_000)), ("DROP_NEW", 32_768, range(32_768)), ("BLOCK_PRODUCER", 131_072, range(50_000)),
        ("DROP_OLD", 1, range(0))
    ]
)
def test_overflow_of_a_burst(spark, policy, capacity, kept):
    burst = spark.range(50_000).select("id", F.floor(F.col("id") / 7).alias("arrival_us"))
    got = lanes.overflow(burst, capacity, policy).where("kept").agg(F.min("id"), F.max("id"), F.count("*")).first()
    assert tuple(got) == ((kept[0], kept[-1], len(kept)) if len(kept) else (None, None, 0))


def test_ring_of_dead_letters(spark):
    letters = spark.range(1500).select("id", F.col("id").alias("drop_seq"), F.lit("r").alias("reason"))
    assert dead_letters.newest(letters).agg(F.min("id"), F.count("*")).first()[:] == (500, 1000)
    assert [r.id for r in dead_letters.recent(letters, 3).collect()] == [1499, 1498, 1497]
    assert tuple(dead_letters.statistics(letters).first()) == (1500, 1000, "r", 1499)


def test_health_is_strict(spark):
    df = spark.createDataFrame(
        [("a", 97, 3, 0), ("b", 98, 2, 0), ("c", 0, 0, 5001), ("d", 0, 0, 5000)], "component string, processed long, dropped long, queue_depth long"
    )
    got = {r.component: r.health for r in metrics.health(df).collect()}
    assert got == {"a": "UNHEALTHY", "b": "HEALTHY", "c": "UNHEALTHY", "d": "HEALTHY"}
    rates = [r.r for r in df.orderBy("component").select(metrics.drop_rate(F.col("processed"), F.col("dropped")).alias("r")).collect()]
    assert rates == [3, 2, 0, 0]


def fates_of(spark, rows, registry=None, **options):
    """Fates by position of rows (id, lane's priority, topic, body, arrival_us, elapsed_ms)."""
    events = spark.createDataFrame(
        [(k, i, p, t, bytes(b), at, ms) for k, (i, p, t, b, at, ms) in enumerate(rows)],
        "k int, id long, effective_priority int, topic string, body binary, arrival_us long, elapsed_ms long"
    )
    handled = lanes.processed(events.withColumn("lane", routing.lane(F.col("effective_priority"))), registry or handlers.default_registry())
    return {r.k: (r.status, r.letter, r.processed, r.dropped, r.stored, r.attempts) for r in lanes.fates(handled, **options).collect()}


REFUSED = "empty audit log body"


def test_realtime_fates(spark):
    got = fates_of(spark, [(1, 4, "a", b"x", 0, 5), (2, 4, "a", b"x", 0, 6), (3, 3, "audit", b"", 0, 9), (4, 3, "sensor/pressure", [201], 0, 0)])
    assert got == {
        0: ("processed", None, 1, 0, True, 1), 1: ("late", "sla_breach", 1, 1, False, 1), 2: ("dropped", REFUSED, 0, 1, False, 0),
        3: ("processed", None, 1, 0, True, 1)
    }


def test_batch_lane_refusals_count_as_dropped(spark):
    rows = [(1, 0, "audit", b"", 0, 0), (2, 0, "audit", b"x", 0, 0)]
    assert fates_of(spark, rows) == {0: ("dropped", REFUSED, 0, 1, False, 0), 1: ("processed", None, 1, 0, True, 1)}
    assert fates_of(spark, rows, dropping=True) == {k: ("dropped", "backpressure_drop", 0, 1, False, 0) for k in (0, 1)}


def test_transactional_fates(spark):
    hour = 3_600_000_000
    rows = [
        (7, 2, "audit", b"", 0, 0), (7, 2, "audit", b"x", 1, 0), (7, 1, "audit", b"", 2, 0), (7, 2, "audit", b"x", 1 + hour, 0),
        (7, 2, "audit", b"x", 2 + hour, 0), (8, 2, "a", b"", 5, 0), (8, 2, "a", b"", 5, 0)
    ]
    got = fates_of(spark, rows)
    gone, done = ("duplicate", None, 0, 0, False, 0), ("processed", None, 1, 0, True, 1)
    assert [got[k] for k in range(5)] == [("dropped", REFUSED, 0, 1, False, 0), done, gone, gone, done]
    assert sorted([got[5], got[6]]) == sorted([gone, done], key=repr) or {got[5], got[6]} == {gone, done}
    assert fates_of(spark, rows[:1], paused=True) == {0: ("dropped", "processor_paused", 0, 1, False, 0)}
    carried = spark.createDataFrame([(7, 0, 1, 0)], "key long, time long, id long, number long")
    assert fates_of(spark, rows[1:2], carried=carried) == {0: gone}


@dataclass(frozen=True)
class Refuses(handlers.Handler):
    outcome: str = "FAIL"

    def failure(self):
        return F.lit(self.outcome)

    def message(self):
        return F.lit("no")


@pytest.mark.parametrize("outcome", ["FAIL", "DROP"])
def test_handlers_that_fail(spark, outcome):
    registry = handlers.Registry().register("a", Refuses("A", outcome))
    got = fates_of(spark, [(1, 4, "a", b"x", 0, 9), (2, 2, "a", b"x", 0, 0), (3, 0, "a", b"x", 0, 0)], registry)
    assert got == {
        0: ("dropped", "no", 0, 1, False, 1), 1: ("dropped", "max_retries_exceeded", 0, 1, False, 3), 2: ("failed_at_flush", "no", 1, 0, False, 1)
    }


def test_metrics_of_fates(spark):
    events = spark.createDataFrame(
        [("B", "dropped", 0, 1, 5), ("B", "processed", 1, 0, 3), ("R", "late", 1, 1, 9)],
        "processor string, status string, processed int, dropped int, arrival_us long"
    )
    got = {r.component: tuple(r)[1:] for r in metrics.by_component(events).collect()}
    assert got == {"B": (1, 1, 0, 3), "R": (1, 1, 0, None)}


@pytest.mark.parametrize("seed", range(4))
def test_chains_over_ranges_equal_a_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(chains, "CELLS", 2)
    rng = np.random.default_rng(seed)
    rows = [
        (int(k), int(t), i, bool(ok)) for i,
        (k, t, ok) in enumerate(zip(rng.integers(0, 4, 400), rng.integers(0, 3000, 400), rng.random(400) < 0.7, strict=True))
    ]
    want, windows = {}, {}
    for k in range(4):
        last, anchor, number = None, None, 0
        for _, t, i, ok in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if last is not None and t - last <= 40:
                want[i] = "duplicate"
            else:
                want[i] = "processed" if ok else "failed"
                last = t if ok else last
            anchor = t if anchor is None else anchor
            windows[i] = number
            if t - anchor >= 100:
                anchor, number = t, number + 1
        windows |= {(k, "last"): number}
    df = spark.createDataFrame(rows, "k long, t long, id long, ok boolean")
    assert {r.id: r.status for r in anchored.dedup(df, "k", "t", "id", F.col("ok"), 40).collect()} == want
    got = anchored.anchored_windows(df, "k", "t", "id", 100).collect()
    assert {r.id: r.window for r in got} == {i: w for i, w in windows.items() if not isinstance(i, tuple)}
    assert all(r.flushed == (r.window < windows[r.k, "last"]) for r in got)
    half = df.where("t < 1500"), df.where("t >= 1500")
    points = anchored.last_points(half[0].select(F.col("k").alias("key"), F.col("t").alias("time"), "id", F.lit(True).alias("ok")), 100)
    second = anchored.anchored_windows(half[1], "k", "t", "id", 100, points).collect()
    assert {r.id: r.window for r in second} == {r.id: windows[r.id] for r in second}


def test_chains_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1, 1), (1, None, 2), (1, 5, 3)], "k long, t long, id long")
    assert {r.id: r.status for r in anchored.dedup(df, "k", "t", "id", F.lit(True), 9).collect()} == {1: "processed", 2: "processed", 3: "processed"}
    assert anchored.anchored_windows(df.limit(0), "k", "t", "id", 9).count() == 0


def test_subscribers_leave_and_fail(spark):
    events = spark.createDataFrame([(1, 2, "a/x", b"1"), (2, 2, "b", b"")], "id long, effective_priority int, topic string, body binary")
    subs, seen = Subscriptions(), []
    subs.subscribe("a/", lambda df: seen.append(df.count()))
    subs.subscribe(None, lambda df: 1)
    subs.subscribe("b", lambda df: 1 / 0)
    subs.notify(events)
    subs.notify(events)
    assert seen == [1, 1] and len(subs.active) == 2 and len(subs.errors) == 2
    assert fan_out(events, {"all": "", "b": "b"}).count() == 3


def test_alert_handlers_fail_alone_and_drops_are_told(spark, caplog):
    raised = spark.createDataFrame([(3, "hot", "s", 1, 5)], "level int, message string, source string, event_id long, timestamp_ns long")
    seen = []
    alerts = Alerts(broken=lambda df: 1 / 0).add("rows", lambda df: seen.append(df.count())).add("log", log_alerts)
    alerts.raise_all(raised)
    assert seen == [1] and [n for n, _ in alerts.errors] == ["broken"] and "[EMERGENCY] s - hot" in caplog.text
    subs = Subscriptions()
    subs.subscribe_dropped(lambda df: seen.append(df.count()))
    subs.subscribe_dropped(lambda df: 1)
    subs.notify_dropped(raised)
    subs.notify_dropped(raised)
    assert seen == [1, 1, 1] and len(subs.dropped) == 1


def test_many_keys_need_no_group_each(spark):
    """Keys of one point, of points within the time to live, of long chains, and with a point from before, against a walk."""
    rng, ttl = np.random.default_rng(3), 100
    rows, carried = [], []
    for k in range(300):
        far = (50, 150, 20_000)[k % 3]
        rows += [(k, int(t), 1000 * k + i, bool(rng.random() < 0.8)) for i, t in enumerate(rng.integers(0, far, rng.integers(1, 12)))]
        if k % 4 == 0:
            carried.append((k, int(rng.integers(-120, 1)), -1 - k, 0))
    df = spark.createDataFrame(rows, "k long, t long, id long, ok boolean")
    given = spark.createDataFrame(carried, "key long, time long, id long, number long")
    for before in (None, given):
        last, want = {k: t for k, t, *_ in carried} if before is not None else {}, {}
        for k in range(300):
            own = sorted(r[1:] for r in rows if r[0] == k)
            status = anchored.dedup_status(np.array([t for t, *_ in own]), np.array([ok for *_, ok in own]), ttl, last.get(k))[0]
            want |= {r[1]: s for r, s in zip(own, status, strict=True)}
        x = anchored.dedup(df, "k", "t", "id", F.col("ok"), ttl, before)
        got = {r.id: r.status for r in x.collect()}
        assert got == want, [(r, got[r[2]], want[r[2]], last.get(r[0])) for r in rows if got[r[2]] != want[r[2]]][:9]
        assert "FlatMapGroupsInPandas" not in x._jdf.queryExecution().toString()
