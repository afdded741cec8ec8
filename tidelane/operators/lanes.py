"""What each lane does with its events: alerts and service levels, duplicates and retries, batch drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchored import dedup
from .handlers import Registry, handle
from .model import BATCH, PROCESSORS, REALTIME, TRANSACTIONAL, AlertLevel

MAX_PROCESSING_MS = 5
MAX_RETRIES = 3
DEDUP_TTL_US = 3_600_000_000
PURGE = 64
# Reasons of drops that no handler gives.
PAUSED, EXCEEDED, BACKPRESSURE, BREACH = "processor_paused", "max_retries_exceeded", "backpressure_drop", "sla_breach"


def processor(lane: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in PROCESSORS.items():
        out = F.when(lane == name, p).otherwise(out)
    return out


def processed(routed: DataFrame, registry: Registry) -> DataFrame:
    """routed with each event's handling and the processor of its lane."""
    return handle(routed, registry).withColumn("processor", processor(F.col("lane")))


def _failed() -> Column:
    """Whether an event that passed its checks was handled without success."""
    return F.col("reason").isNull() & F.col("outcome").isin("DROP", "FAIL")


def _realtime(max_ms: int) -> Column:
    late = F.coalesce(F.col("elapsed_ms") > max_ms, F.lit(False))
    return F.when(F.col("outcome").isin("DROP", "FAIL"), "dropped").when(late, "late").otherwise("processed")


def _batch(dropping: bool) -> Column:
    if dropping:
        return F.lit("dropped")
    return F.when(F.col("reason").isNotNull(), "dropped").when(_failed(), "failed_at_flush").otherwise("processed")


def _told(x: DataFrame, paused: bool = False, dropping: bool = False) -> DataFrame:
    """x, which has status, with what follows from it."""
    status, lane, message = F.col("status"), F.col("lane"), F.coalesce("message", F.lit(""))
    dropped = F.when(F.col("reason").isNotNull(), F.col("reason")).when(lane == TRANSACTIONAL, EXCEEDED).otherwise(message)
    tries = F.when((status == "duplicate") | F.col("reason").isNotNull(), 0).when(
        (lane == TRANSACTIONAL) & (status == "dropped"), MAX_RETRIES
    ).otherwise(1)
    for on, of, why in ((paused, TRANSACTIONAL, PAUSED), (dropping, BATCH, BACKPRESSURE)):
        if on:
            dropped, tries = F.when(lane == of, why).otherwise(dropped), F.when(lane == of, 0).otherwise(tries)
    letter = F.when(status == "dropped", dropped).when(status == "late", BREACH).when(status == "failed_at_flush", message)
    return x.withColumns({
        "letter": letter, "processed": status.isin("processed", "late", "failed_at_flush").cast("int"),
        "dropped": status.isin("dropped", "late").cast("int"), "stored": status == "processed", "attempts": tries.cast("int")
    })


def fates(
    handled: DataFrame, key: str = "id", ttl_us: int | None = DEDUP_TTL_US, max_ms: int = MAX_PROCESSING_MS, paused: bool = False,
    dropping: bool = False, carried: DataFrame | None = None
) -> DataFrame:
    """handled with what becomes of each event in its lane: status, letter, processed, dropped, stored, attempts.

    letter is the reason with which the event goes to the dead letters, null if it doesn't; processed and dropped
    are what it adds to its processor's counters; stored tells whether it is stored and delivered to observers;
    attempts is how often its handler is called.

    * Realtime: a refused or failed event is dropped; one over max_ms counts as processed and as dropped, and isn't
      stored.
    * Transactional: while paused all are dropped. A duplicate of an event processed within ttl_us leaves no trace;
      a refused event is dropped without a try, a failing one after MAX_RETRIES. Only success is remembered.
    * Batch: while dropping all are dropped. A refused event is dropped; others count as processed when they are
      buffered, and if they fail when their window is flushed go to the dead letters without being counted.

    Only the transactional lane's rows are shuffled, by key. carried is as in anchored.dedup().
    """
    lane, fast, slow = F.col("lane"), _realtime(max_ms), _batch(dropping)
    if paused:
        x = handled.withColumn("status", F.when(lane == REALTIME, fast).when(lane == TRANSACTIONAL, "dropped").otherwise(slow))
        return _told(x, paused, dropping)
    ok = F.col("reason").isNull() & ~_failed()
    told = dedup(handled.where(lane == TRANSACTIONAL), key, "arrival_us", "id", ok, ttl_us, carried).withColumn(
        "status", F.when(F.col("status") == "failed", "dropped").otherwise(F.col("status"))
    )
    others = handled.where(lane != TRANSACTIONAL).withColumn("status", F.when(lane == REALTIME, fast).otherwise(slow))
    return _told(told.unionByName(others), False, dropping)


def realtime(handled: DataFrame, max_ms: int = MAX_PROCESSING_MS) -> DataFrame:
    """The realtime lane with its fates, and breach: over max_ms."""
    x = _told(handled.where(F.col("lane") == REALTIME).withColumn("status", _realtime(max_ms)))
    return x.withColumn("breach", F.col("status") == "late")


def alerts(handled: DataFrame, max_ms: int = MAX_PROCESSING_MS) -> DataFrame:
    """(level, message, source, event_id, timestamp_ns, context): alerts of the realtime lane; other lanes raise none."""
    x = realtime(handled, max_ms)
    late = F.concat(F.lit("SLA breach: "), F.col("elapsed_ms").cast("string"), F.lit(f"ms > {max_ms}ms"))
    alert = lambda level, message: F.struct(level.cast("int").alias("level"), message.alias("message"))
    raised = F.array_compact(F.array(
        F.when(F.col("alert_level").isNotNull(), alert(F.col("alert_level"), F.col("message"))),
        F.when(F.col("breach"), alert(F.lit(int(AlertLevel.WARNING)), late))
    ))
    x = x.select(F.explode(raised).alias("a"), "topic", "id", "ts_ns", "body")
    return x.select(
        "a.level", "a.message", F.col("topic").alias("source"), F.col("id").alias("event_id"), F.col("ts_ns").alias("timestamp_ns"),
        F.col("body").alias("context")
    )


def transactional(handled: DataFrame, paused: bool = False, key: str = "id", ttl_us: int | None = DEDUP_TTL_US) -> DataFrame:
    """The transactional lane with its fates."""
    return fates(handled.where(F.col("lane") == TRANSACTIONAL), key, ttl_us, paused=paused)


def dropping_batch(handled: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """The batch lane while it drops: every event goes to the dead letters, and each drop purges the queue, too.

    purged marks, if given (id), events that were taken off the queue before they came here; these have no letter.
    """
    x = _told(handled.where(F.col("lane") == BATCH).withColumn("status", F.lit("dropped")), dropping=True)
    gone = F.lit(False) if purged is None else F.col("__purged").isNotNull()
    if purged is not None:
        x = x.join(purged.select(F.col("id").alias("__purged")), F.col("id") == F.col("__purged"), "left")
    x = x.withColumns({"letter": F.when(~gone, F.col("letter")), "dropped": F.when(gone, 0).otherwise(F.col("dropped"))})
    return x.drop("__purged") if purged is not None else x


def purge(handled: DataFrame, lane: str = BATCH, most: int = PURGE) -> DataFrame:
    """The first `most` events of a lane by arrival: a feature of this operator, planned as a top-k."""
    return handled.where(F.col("lane") == lane).orderBy("arrival_us", "id").limit(most)


def destination(proc: Column, topic: Column) -> Column:
    """Where observers of a processor send a processed event; null for none."""
    # Processors, prefixes and services.
    rules = [
        (
            "RealtimeProcessor", "sensor/pressure", "emergency-svc"
        ), ("RealtimeProcessor", "sensor/temperature", "monitoring"), ("TransactionalProcessor", "payment", "payment-status"),
        (
            "TransactionalProcessor", "state", "state-change"
        ), ("TransactionalProcessor", "audit", "compliance"), ("BatchProcessor", "audit", "analytics"),
    ]
    out = F.lit(None).cast("string")
    for p, prefix, service in reversed(rules):
        out = F.when((proc == p) & F.startswith(topic, F.lit(prefix)), service).otherwise(out)
    return out


def overflow(burst: DataFrame, capacity: int, policy: str, part_rows: int = 50_000) -> DataFrame:
    """burst (id, arrival_us, ...) with kept, for a queue that nothing consumes meanwhile.

    DROP_OLD keeps the newest capacity - 1, for a ring leaves a place empty; DROP_NEW and BLOCK_PRODUCER keep
    the first `capacity`. Only the row at the limit is looked for, by counts of ranges of arrival and an order
    within one range; all others are told by comparing with it.
    """
    keep, newest = (capacity - 1, True) if policy == "DROP_OLD" else (capacity, False)
    key = F.struct("arrival_us", "id")
    ends = burst.agg(F.min("arrival_us").alias("low"), F.max("arrival_us").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if keep >= ends.n:
        return burst.withColumn("kept", F.lit(True))
    if keep <= 0:
        return burst.withColumn("kept", F.lit(False))
    parts = min(100_000, max(64, ends.n // part_rows))
    width = (ends.high - ends.low) // parts + 1
    ranged = burst.select("arrival_us", "id", F.floor((F.col("arrival_us") - ends.low) / width).alias("part"))
    before = 0
    for r in sorted(ranged.groupBy("part").count().collect(), key=lambda r: -r.part if newest else r.part):
        if before + r["count"] >= keep:
            break
        before += r["count"]
    order = [F.desc("arrival_us"), F.desc("id")] if newest else ["arrival_us", "id"]
    at = ranged.where(F.col("part") == r.part).withColumn(
        "n", F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ).where(F.col("n") == keep - before).first()
    limit = F.struct(F.lit(at.arrival_us).alias("arrival_us"), F.lit(at.id).alias("id"))
    return burst.withColumn("kept", key >= limit if newest else key <= limit)
