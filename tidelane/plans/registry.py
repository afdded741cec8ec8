"""The registered queries, by name, and their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions import histogram
from tidelane.operators import anchored, dead_letters, lanes, metrics, model, routing, subscribe
from tidelane.operators.handlers import Handler, default_registry, with_body_numbers
from tidelane.sources import event_log, frames
from tidelane.sources import topics as topic_files
from tidelane.streaming import pipeline, stateful

from .event_sql import DAY, HOUR, SQL, TOPICS

Query = Callable[[SparkSession, str], DataFrame]


def _topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPICS, "topic string, priority int")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.from_events_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_events(spark, sf_dir), _topics(spark))


def _handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes.processed(_routed(spark, sf_dir), default_registry())


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each event, duplicates told by dedup_id within a day."""
    return lanes.fates(_handled(spark, sf_dir), "dedup_id", DAY)


def _count(*by: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))


def _on(source: Callable[[SparkSession, str], DataFrame], *steps: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir)
        for step in steps:
            df = step(df)
        return df

    return query


def _pick(*columns) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*columns)


def _done(df: DataFrame) -> DataFrame:
    return df.where("stored")


@dataclass(frozen=True)
class Refusing(Handler):
    """A handler that fails for some ids, to show what follows from that in each lane."""

    every: int = 2
    below: int = 1
    outcome: str = "FAIL"
    says: str = ""

    def failure(self) -> Column:
        return F.when(F.col("id") % self.every < self.below, self.outcome)

    def message(self) -> Column:
        return F.when(F.col("id") % self.every < self.below, self.says)


def _handler_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = default_registry().register("state", Refusing("State", 7, 2, "FAIL", "state refused")).register(
        "analytics", Refusing("Analytics", 3, 1, "DROP", "analytics refused")
    )
    registry.register("sensor/1", Refusing("Hot", 4, 1, "DROP", "reading refused"))
    told = lanes.fates(lanes.processed(_routed(spark, sf_dir), registry), "id", None)
    return told.select("id", "lane", "status", "letter", "processed", "dropped", "stored", "attempts")


def _reasons(rules: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry, events = default_registry(), with_body_numbers(_routed(spark, sf_dir))
        events = events.withColumn("number", registry.number())
        x = events.withColumns({
            "handler": registry.choose(lambda h: F.lit(h.name), F.col("number")), "invalid": registry.choose(lambda h: h.validate(), F.col("number")),
            "against": registry.choose(lambda h: h.rules(), F.col("number"))
        })
        reason = F.when(F.col("invalid").isNull(), F.col("against")) if rules else F.col("invalid")
        return x.withColumn("reason", reason).where("reason is not null").groupBy("handler", "reason").agg(F.count(F.lit(1)).alias("events"))

    return query


def _frame(x: DataFrame) -> DataFrame:
    return x.withColumn("frame", frames.encode(F.col("priority"), F.col("topic"), F.col("body")))


def _frame_decode(x: DataFrame) -> DataFrame:
    out = frames.decode_frame(_frame(x).select("id", "frame"), "frame")
    return out.select("id", "priority", "topic", F.length("payload").cast("long").alias("payload_len"))


def _broken(x: DataFrame) -> DataFrame:
    """(id, frame): whole frames, and frames broken in six ways by id."""
    hexed = lambda text: F.unhex(F.lit(text))
    kind = F.col("id") % 7
    broken = F.when(kind == 1, hexed("0000")).when(
        kind == 2, F.concat("frame", hexed("00"))
    ).when(kind == 3, hexed("000000020300")).when(kind == 4, hexed("0000000405000161")).when(kind == 5, hexed("0000000402000961")).when(kind == 6, hexed("00000004020000FF")).otherwise(F.col("frame"))
    return _frame(x).select("id", broken.alias("frame"))


def _frame_errors(x: DataFrame) -> DataFrame:
    return frames.decode_frame(_broken(x), "frame").groupBy("error").agg(F.count(F.lit(1)).alias("frames"))


def _windows(df: DataFrame) -> DataFrame:
    """Windows of what the batch lane buffers."""
    here = df.where("lane = 'BATCH' and reason is null").select(F.col("topic").alias("key"), F.col("arrival_us").alias("time"), "id")
    return anchored.anchored_windows(here, "key", "time", "id", HOUR)


def _window_rows(df: DataFrame) -> DataFrame:
    return _windows(df).groupBy("key", "window").agg(
        F.count(F.lit(1)).alias("events"), F.min("time").alias("first_us"), F.max("time").alias("last_us"), F.bool_and("flushed").alias("flushed")
    )


def _letters(df: DataFrame) -> DataFrame:
    return dead_letters.dead_letters(df)


def _burst(capacity: int, policy: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: lanes.overflow(df.where("lane = 'REALTIME'").select("id", "arrival_us"), capacity, policy).select("id", "kept")


def _bus_and_processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_component(_fates(spark, sf_dir)).unionByName(metrics.bus_component(_routed(spark, sf_dir)))


def _hist(df: DataFrame) -> DataFrame:
    return histogram.log2_histogram(df, "latency_ns")


def _enum_names(df: DataFrame) -> DataFrame:
    name = model.names_of(model.Priority, F.col("priority"))
    return df.select(
        "priority", name.alias("name"), model.values_of(model.Priority, name).alias("value")
    ).groupBy("priority", "name", "value").agg(F.count(F.lit(1)).alias("events"))


def _union(df: DataFrame) -> DataFrame:
    tcp, udp = (df.where(F.col("id") % 2 == k).select("id", F.lit(k).alias("source_type")) for k in (0, 1))
    return tcp.unionByName(udp).groupBy("source_type").agg(F.count(F.lit(1)).alias("events"), F.sum("id").alias("ids"))


_LINES = ["# comment", "", "sensor/1:CRITICAL # hot", "  a b :\tLOW\r", "no colon", "bad:URGENT", "late:HIGH", "late:BATCH", "two:LOW:HIGH"]


def _topic_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_files.parse_topics(spark.createDataFrame(list(enumerate(_LINES)), "line int, value string"))


def _topic_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = topic_files.parse_topics(spark.createDataFrame([(0, "a b:HIGH"), (1, "new:MEDIUM")], "line int, value string"))
    return topic_files.merge_topics(_topic_file(spark, sf_dir), new)


def _log(df: DataFrame) -> DataFrame:
    logs = df.select(event_log.encode(F.col("ts_ns"), F.col("source_type"), F.col("id"), F.col("topic"), F.col("body")).alias("content"))
    return event_log.decode(logs).select("id", "ts_ns", "source_type", "topic", F.length("body").cast("long").alias("body_len"))


def _home(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, and all runs in this process, under a temporary one."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidelane-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, of: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What the events table gives as a stream of files, all of it read in one run."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, leaf = os.path.split(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if whole else leaf).parquet(path if whole else folder)
    return pipeline.run_available(of(stream), _home(spark, "stream"), mode)


def _stream_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda s: _count("lane")(routing.route(model.from_events_table(s), _topics(spark))), "complete")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(
        spark, sf_dir, lambda s: stateful.dedup(model.from_events_table(s), "dedup_id", "arrival_us", "id", "id % 11 <> 0", 6 * HOUR), "append"
    ).select("key", "id", "status")


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(
        spark, sf_dir, lambda s: stateful.anchored_windows(model.from_events_table(s), "topic", "arrival_us", "id", HOUR), "append"
    ).groupBy("key", "window").agg(F.count(F.lit(1)).alias("events"))


def _engine_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as frames, of which each connection's bytes are cut in two captures amid a frame, through the engine to its store."""
    home = _home(spark, "engine")
    framed = _frame(_events(spark, sf_dir)).select((F.col("id") % 64).alias("c"), "id", F.hex("frame").alias("frame"))
    streams = framed.groupBy("c").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "frame"))), lambda x: x["frame"]), ""
    ).alias("all"))
    half = F.floor(F.length("all") / 4).cast("int") * 2 + 2 * (F.col("c") % 3)
    parts = streams.select(F.format_string("c%02d", "c").alias("connection"), half.alias("half"), "all").select(
        "connection",
        F.explode(F.array(
            F.struct(F.lit("1").alias("part"), F.expr("unhex(substr(all, 1, half))").alias("content")),
            F.struct(F.lit("2").alias("part"), F.expr("unhex(substr(all, half + 1))").alias("content"))
        )).alias("p")
    )
    captures = parts.select(
        F.concat("connection", F.lit("/"), "p.part").alias("path"), F.timestamp_seconds(F.lit(0)).alias("modificationTime"),
        F.col("p.content").alias("content")
    )
    engine = pipeline.Engine(_topics(spark), home, max_ms=1 << 40)
    for number, part in enumerate(("1", "2")):
        engine.process_captures(captures.where(F.endswith("path", F.lit(part))), number, F.substring_index("path", "/", 1))
    engine.stop()
    return engine.table("events").groupBy("topic").agg(F.count(F.lit(1)).alias("events"), F.sum("body_len").alias("bytes"))


def _dedup(ok, ttl: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: anchored.dedup(df, "dedup_id", "arrival_us", "id", ok, ttl).select(F.col("dedup_id").alias("key"), "id", "status")


def _ingest(df: DataFrame) -> DataFrame:
    """Frames of two sources, broken in six ways by id, and what is counted of them."""
    decoded = frames.decode_frame(_broken(df), "frame")
    return metrics.ingest_counters(decoded.select(
        F.when(F.col("id") % 2 == 0, "tcp").otherwise("udp").alias("source"), (F.col("id") % 20).alias("connection"), "error",
        F.length("frame").alias("bytes")
    ))


def _at_end(df: DataFrame) -> int:
    return df.agg(F.max("arrival_us")).first()[0] or 0


#: Queries without SQL: DuckDB has no crc32, and the clean-ups of the lazy mode follow the whole stream's order.
WITHOUT_SQL = ["crc32_body", "dedup_lazy_cleanup"]


def queries() -> dict[str, Query]:
    """Each query builds its columns when it is called, for these need a session."""
    return {name: lambda spark, sf_dir, name=name: _built()[name](spark, sf_dir) for name in [*SQL, *WITHOUT_SQL]}


def _built() -> dict[str, Query]:
    good = F.lit(True)
    not_eleventh = F.col("id") % 11 != 0
    return {
        "lane_counts": _on(_routed, _count("lane")),
        "effective_priority": _on(_routed, _pick("id", "topic", "priority", "effective_priority", "lane")),
        "topic_lookup_left": lambda s, d: _count("topic", "table_priority")(routing.with_table_priority(_events(s, d), _topics(s))),
        "handler_longest_prefix": _on(_handled, _count("topic", "handler")),
        "validate_reasons": _reasons(False),
        "rule_violations": _reasons(True),
        "alerts_realtime": _on(_handled, lanes.alerts, _pick("level", "message", "source", "event_id")),
        "alerts_suppressed_other_lanes": _on(
            _handled, lambda x: x.where("lane <> 'REALTIME' and alert_level is not null"), _count("lane", "alert_level")
        ),
        "payment_amounts": _on(
            _handled, lambda x: x.where("handler = 'PaymentEventHandler' and outcome = 'SUCCESS'"),
            _pick("id", F.regexp_extract("message", "[0-9]+", 0).cast("long").alias("amount"), "message")
        ),
        "lane_outcomes": _on(_handled, _count("lane", "handler", "outcome", "reason", "alert_level")),
        "destinations": _on(_fates, _done, _pick("id", "processor", lanes.destination(F.col("processor"), F.col("topic")).alias("destination"))),
        "subscribe_prefix": _on(
            _fates, _done, lambda x: subscribe.external(subscribe.matching(x, "sensor/")), _pick("id", "priority", "topic", "body_len")
        ),
        "subscriber_fanout": _on(
            _fates, _done, lambda x: subscribe.fan_out(x, {"all": "", "pay": "payment", "sense": "sensor/", "temp": "sensor/temperature"}),
            _pick("subscriber", "id", "topic")
        ),
        "frame_decode": _on(_events, _frame_decode),
        "frame_errors": _on(_events, _frame_errors),
        "crc32_body": _on(_events, _pick("id", "body_len", "crc32")),
        "batch_windows_anchored": _on(_handled, _window_rows),
        "batch_window_flush_counts": _on(
            _handled, _windows,
            lambda w: w.where("flushed").groupBy("key").agg(F.countDistinct("window").alias("windows"), F.count(F.lit(1)).alias("events"))
        ),
        "batch_tail_unflushed": _on(_handled, _windows, lambda w: w.where("not flushed"), _count("key")),
        "tumbling_windows": _on(_events, lambda x: anchored.tumbling_windows(x, "topic", "arrival_us", HOUR), _count("topic", "window")),
        "dedup_no_expiry": _on(
            _events,
            lambda x: anchored.dedup(x, "dedup_id", "arrival_us", "id", good, None).groupBy("dedup_id").agg(
                F.min(F.when(F.col("status") == "processed", F.col("id"))).alias("first_id"), F.count(F.lit(1)).alias("events")
            )
        ),
        "dedup_ttl": _on(_events, _dedup(good, 6 * HOUR)),
        "dedup_success_only": _on(_events, _dedup(not_eleventh, 6 * HOUR)),
        "dedup_lazy_cleanup": _on(
            _events, lambda x: anchored.lazy_dedup(x, "dedup_id", "arrival_us", "id", not_eleventh, HOUR, 10_000_000).select("key", "id", "status")
        ),
        "transactional_status": _on(
            _handled, lambda x: lanes.transactional(x, key="dedup_id", ttl_us=DAY),
            _pick("id", "status", F.col("letter").alias("final_reason"), "attempts")
        ),
        "dlq_all": _on(_fates, _letters),
        "dlq_last_n": _on(_fates, _letters, dead_letters.newest, _pick("id", "reason")),
        "dlq_recent": _on(_fates, _letters, dead_letters.recent, _pick("id", "reason")),
        "dlq_stats": _on(_fates, _letters, dead_letters.statistics),
        "dlq_text": _on(_fates, _letters, dead_letters.text_line),
        "overflow_drop_old": _on(_routed, _burst(100, "DROP_OLD")),
        "overflow_drop_new": _on(_routed, _burst(100, "DROP_NEW")),
        "overflow_block": _on(_routed, _burst(250, "BLOCK_PRODUCER")),
        "pressure_latch": _on(
            _routed, lambda x: routing.pressure_latch(x, 120, 140).where("effective_priority >= 3"), _pick("id", "rank", "lane_after", "pressure")
        ),
        "purge_batch_64": _on(_handled, lanes.purge, _pick("id", "topic")),
        "sla_breach": _on(_handled, lanes.realtime, _pick("id", "elapsed_ms", "breach", "stored", "processed", "dropped")),
        "pause_transactions": _on(
            _handled, lambda x: lanes.transactional(x, paused=True), _pick("id", "status", F.col("letter").alias("final_reason"))
        ),
        "drop_batch_mode": _on(_handled, lanes.dropping_batch, _pick("id", F.col("letter").alias("final_reason"))),
        "metrics_by_component": _on(_fates, metrics.by_component),
        "drop_rate_percent": _on(
            _fates, metrics.by_component, _pick("component", metrics.drop_rate(F.col("processed"), F.col("dropped")).alias("drop_rate"))
        ),
        "health_status": _on(_fates, metrics.by_component, metrics.health, _pick("component", "health")),
        "engine_totals_component_sum": _on(_bus_and_processors, metrics.totals),
        "engine_totals_unique": _on(_fates, metrics.by_component, metrics.totals),
        "latency_histogram": _on(_events, _hist),
        "latency_percentiles": _on(_events, _hist, lambda h: histogram.histogram_percentiles(h, [50, 99, 99.9])),
        "latency_min_max": _on(_events, _hist, histogram.histogram_bounds),
        "exact_percentiles": _on(_routed, lambda x: histogram.exact_percentiles(x, "latency_ns", [50, 90, 99], "lane")),
        "retry_attempts": _on(_fates, lambda x: x.where("lane = 'TRANSACTIONAL'"), _count("status", "attempts")),
        "producer_union": _on(_events, _union),
        "priority_enum_names": _on(_events, _enum_names),
        "topic_file": _topic_file,
        "topic_reload": _topic_reload,
        "event_log_round_trip": _on(_events, _log),
        "stored_by_id": _on(_routed, lambda x: event_log.find(x, 77), _pick("id", "topic", "lane")),
        "stream_lane_counts": _stream_lanes,
        "stream_dedup": _stream_dedup,
        "stream_batch_windows": _stream_windows,
        "handler_failures": _handler_failures,
        "ingest_counters": _on(_events, _ingest),
        "stage_latencies": _on(
            _events,
            lambda x: metrics.stage_latencies(
                x.select(
                    "id", "ts_ns", (F.col("ts_ns") + 1000 * (F.col("id") % 7)).alias("out_ns"),
                    (F.col("ts_ns") + 1000 * (F.col("id") % 7) + F.col("latency_ns")).alias("done_ns")
                ),
                "ts_ns", "out_ns", "done_ns"
            ),
            _pick("id", "ingest_to_dequeue_ns", "dequeue_to_done_ns", "total_ns")
        ),
        "success_latency_histogram": _on(_fates, lambda x: metrics.success_latencies(x, "latency_ns"), _hist),
        "dedup_state_size": lambda s, d: metrics.remembered(_fates(s, d), "dedup_id", _at_end(_events(s, d)), DAY, 8),
        "queue_depth_by_lane": lambda s, d: metrics.waiting(_routed(s, d), _at_end(_events(s, d))),
        "engine_frames": _engine_frames,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


