from pyspark.sql import functions as F

from tidelane.operators import model
from tidelane.plans.event_sql import TOPICS
from tidelane.sources import frames
from tidelane.streaming import pipeline, stateful

from .conftest import DATA


def engine_of(spark, tmp_path, **options):
    return pipeline.Engine(spark.createDataFrame(TOPICS, "topic string, priority int"), str(tmp_path / "home"), **options)


def test_engine_stores_counts_and_delivers(spark, tmp_path):
    seen, drops = [], []
    engine = engine_of(spark, tmp_path)
    engine.subscriptions.subscribe("payment", lambda df: seen.append(df.count()))
    engine.subscriptions.subscribe_dropped(lambda df: drops.append(df.count()))
    engine.alerts.add("count", lambda df: drops.append(-df.count()))
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    engine.start(model.from_events_table(stream), str(tmp_path / "cp")).awaitTermination()
    engine.stop()
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    stored, letters = engine.table("events"), engine.table("dead_letters")
    assert stored.where("lane = 'REALTIME' and elapsed_ms > 5").count() == 0 and letters.where("reason = 'sla_breach'").count() > 0
    assert stored.count() + letters.count() == n and stored.select("id").distinct().count() == stored.count()
    counts = engine.metrics().agg(F.sum("processed"), F.sum("dropped")).first()
    assert counts[0] == stored.count() + letters.where("reason = 'sla_breach'").count() and counts[1] == letters.count()
    assert sum(seen) == stored.where("topic like 'payment%'").count() > 0 and sum(x for x in drops if x > 0) == letters.count() and min(drops) < 0
    assert engine.health().first().alive is False


def test_the_same_events_twice_are_processed_once_in_a_batch_and_over_batches(spark, tmp_path):
    events = model.from_events_table(spark.read.parquet(f"{DATA}/events.parquet"))
    engine = engine_of(spark, tmp_path, ttl_us=1 << 50)
    engine.process(events.unionByName(events), 0)
    once = engine.table("events").where("lane = 'TRANSACTIONAL'")
    assert once.count() == once.select("id").distinct().count() > 0
    n = once.count()
    again = engine_of(spark, tmp_path, ttl_us=1 << 50)
    again.process(events, 1)
    again.process(events, 1)  # a batch that is repeated replaces itself
    assert again.table("events").where("lane = 'TRANSACTIONAL'").count() == n


def test_batch_windows_go_over_batches(spark, tmp_path):
    row = lambda i, t: (i, 0, t, "batch/topic_0", bytearray(b"x"), 0)
    make = lambda *rows: spark.createDataFrame(
        rows, "id long, priority int, arrival_us long, topic string, body binary, elapsed_ms long"
    ).withColumns({"ts_ns": F.col("arrival_us") * 1000})
    engine = engine_of(spark, tmp_path, window_us=100)
    engine.process(make(row(1, 0), row(2, 50)), 0)
    assert engine.table("events").count() == 0 and engine.metrics().first().queue_depth == 2
    engine.process(make(row(3, 120), row(4, 130)), 1)
    assert sorted(r.id for r in engine.table("events").collect()) == [1, 2, 3]
    engine.process(make(row(5, 230)), 2)
    assert sorted(r.id for r in engine.table("events").collect()) == [1, 2, 3, 4, 5]
    engine.process(make(row(6, 231)), 3)
    engine.stop()
    assert sorted(r.id for r in engine.table("events").collect()) == [1, 2, 3, 4, 5, 6]


def test_pause_and_drop_flags_and_own_processors(spark, tmp_path):
    engine = engine_of(spark, tmp_path, processors={"REALTIME": lambda df: df.where("id % 2 = 0")})
    engine.pause_transactions()
    engine.drop_batch_events()
    engine.process(model.from_events_table(spark.read.parquet(f"{DATA}/events.parquet")))
    got = {r.component: (r.processed, r.dropped) for r in engine.metrics().collect()}
    assert got["TransactionalProcessor"][0] == got["BatchProcessor"][0] == 0 and got["TransactionalProcessor"][1] > 0
    assert engine.table("events").where("lane = 'REALTIME' and id % 2 = 1").count() == 0 < got["RealtimeProcessor"][0]


def test_captures_become_events_even_if_a_frame_is_cut(spark, tmp_path):
    one = bytes(spark.range(1).select(frames.encode(F.lit(4), F.lit("a"), F.unhex(F.lit("0102")))).first()[0])
    data = one * 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c1.1").write_bytes(data[:17])
    (tmp_path / "in" / "c1.2").write_bytes(data[17:])
    (tmp_path / "in" / "c2.1").write_bytes(bytes(44) + one)
    engine = engine_of(spark, tmp_path)
    connection = F.regexp_extract("path", r"([^/]*)[.][0-9]*$", 1)
    engine.start(pipeline.captures_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), captures=True, connection=connection).awaitTermination()
    got = engine.table("events").collect()
    assert len(got) == 5 and {(r.topic, bytes(r.body), r.body_len) for r in got} == {("a", b"\x01\x02", 2)} and len({r.id for r in got}) == 5
    assert {
        r.connection: (bytes(r.tail), r.gave_up) for r in engine.table("frames").where("tail is not null").collect()
    } == {"c1": (b"", False), "c2": (b"", True)}


def test_tails_go_over_batches(spark, tmp_path):
    one = bytes(spark.range(1).select(frames.encode(F.lit(4), F.lit("a"), F.unhex(F.lit("0102")))).first()[0])
    parts = lambda *rows: spark.createDataFrame(rows, "path string, modificationTime timestamp, content binary")
    engine = engine_of(spark, tmp_path)
    engine.process_captures(parts(("x/1", None, bytearray(one + one[:3]))), 0, F.lit("x"))
    engine.process_captures(parts(("x/2", None, bytearray(one[3:] + one))), 1, F.lit("x"))
    assert engine.table("frames").where("body is not null").count() == 3


def test_state_of_duplicates_expires(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "k long, id long, t long"
    hour, day = 3_600_000_000, 86_400_000_000
    seen = []
    for number, rows in enumerate([
        [(1, 1, day), (1, 2, day + hour)], [(2, 3, 9 * day)], [(2, 4, 9 * day + hour), (1, 5, 9 * day)], [(3, 6, 20 * day)]
    ]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        q = stateful.dedup(stream, "k", "t", "id", "true", 2 * hour).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "cp")
        ).foreachBatch(
            lambda b, n: seen.extend((r.id, r.status) for r in b.collect())
        ).trigger(availableNow=True).start()
        q.awaitTermination()
    assert dict(seen) == {1: "processed", 2: "duplicate", 3: "processed", 4: "duplicate", 5: "processed", 6: "processed"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
