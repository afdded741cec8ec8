"""Counters by component, drop rates, health, engine totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_component(told: DataFrame, depth: int = 0) -> DataFrame:
    """(component, processed, dropped, queue_depth, last_event_us) of the processors, from lanes.fates().

    last_event_us is the time of the last event that was processed in time; depth is what a caller knows to wait.
    """
    last = F.max(F.when((F.col("processed") == 1) & (F.col("status") != "late"), F.col("arrival_us")))
    return told.groupBy(F.col("processor").alias("component")).agg(
        F.sum("processed").cast("long").alias("processed"), F.sum("dropped").cast("long").alias("dropped"),
        F.lit(depth).cast("long").alias("queue_depth"), last.alias("last_event_us")
    )


def bus_component(routed: DataFrame) -> DataFrame:
    """The bus's row of the same: it counts each event that it took as processed."""
    return routed.agg(
        F.lit("EventBus").alias("component"), F.count(F.lit(1)).alias("processed"), F.lit(0).cast("long").alias("dropped"),
        F.lit(0).cast("long").alias("queue_depth"), F.max("arrival_us").alias("last_event_us")
    )


def drop_rate(processed: Column, dropped: Column) -> Column:
    """Whole percent of events dropped; 0 without events."""
    all_ = processed + dropped
    return F.when(all_ > 0, F.floor(dropped * 100 / F.when(all_ > 0, all_))).otherwise(0).cast("long")


def health(metrics: DataFrame, max_depth: int = 5000, max_rate: float = 2.0) -> DataFrame:
    """metrics with health: UNHEALTHY if depth or drop rate is over its bound."""
    all_ = F.col("processed") + F.col("dropped")
    rate = F.when(all_ > 0, F.col("dropped") * 100.0 / F.when(all_ > 0, all_)).otherwise(0.0)
    return metrics.withColumn("health", F.when((F.col("queue_depth") > max_depth) | (rate > max_rate), "UNHEALTHY").otherwise("HEALTHY"))


def totals(metrics: DataFrame) -> DataFrame:
    """(processed, dropped, queue_depth) over all rows of metrics; one row."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return metrics.agg(zero("processed"), zero("dropped"), zero("queue_depth"))


def readiness(metrics: DataFrame, alive: bool, pressure: int = 0) -> DataFrame:
    """(alive, ready, pressure); one row: ready while alive and some component has been heard from."""
    return metrics.agg(F.lit(alive).alias("alive"), (F.lit(alive) & (F.count(F.lit(1)) > 0)).alias("ready"), F.lit(pressure).alias("pressure"))


def ingest_counters(decoded: DataFrame) -> DataFrame:
    """(source, connections, events, errors, bytes) of decoded frames (source, connection, error, bytes)."""
    good = F.col("error").isNull()
    return decoded.groupBy("source").agg(
        F.countDistinct("connection").alias("connections"), F.count_if(good).alias("events"), F.count_if(~good).alias("errors"),
        F.sum("bytes").cast("long").alias("bytes")
    )


def stage_latencies(events: DataFrame, ingest: str, dequeue: str, done: str) -> DataFrame:
    """events with ingest_to_dequeue_ns, dequeue_to_done_ns and total_ns."""
    a, b, c = F.col(ingest), F.col(dequeue), F.col(done)
    return events.withColumns({"ingest_to_dequeue_ns": b - a, "dequeue_to_done_ns": c - b, "total_ns": c - a})


def success_latencies(told: DataFrame, latency: str) -> DataFrame:
    """The rows whose latency is recorded: transactional events that succeeded."""
    return told.where((F.col("lane") == "TRANSACTIONAL") & (F.col("status") == "processed") & F.col(latency).isNotNull())


def remembered(told: DataFrame, key: str, at_us: Column | int, ttl_us: int, buckets: int = 4096) -> DataFrame:
    """(bucket, ids): how many keys deduplication remembers at at_us, by key modulo buckets."""
    live = told.where(
        (F.col("lane") == "TRANSACTIONAL") & (F.col("status") == "processed") & (F.col("arrival_us") <= at_us) & (F.col("arrival_us") + ttl_us >= at_us)
    )
    return live.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("bucket")).agg(F.countDistinct(key).alias("ids"))


def waiting(told: DataFrame, at_us: Column | int) -> DataFrame:
    """(lane, queue_depth): events that had arrived by at_us and weren't done yet, by elapsed_ms."""
    done = F.col("arrival_us") + F.coalesce(F.col("elapsed_ms"), F.lit(0)) * 1000
    return told.groupBy("lane").agg(F.count_if((F.col("arrival_us") <= at_us) & (done > at_us)).alias("queue_depth"))
