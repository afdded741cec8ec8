"""The engine as a streaming job: frames or events in, lanes, state, sinks, subscriptions and control."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelane.operators import anchored, dead_letters, lanes, metrics, model, routing
from tidelane.operators.alerts import Alerts
from tidelane.operators.handlers import Registry, default_registry
from tidelane.operators.model import BATCH
from tidelane.operators.subscribe import Subscriptions
from tidelane.sources import frames

WINDOW_US = 60_000_000


def run_available(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, as Parquet beside its checkpoint.

    Each batch is written under its number, so one that is repeated replaces itself; in complete mode the last one
    counts, under one name.
    """
    out = f"{checkpoint}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", f"{checkpoint}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return _read(stream.sparkSession, out, stream.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of batches, empty if there is none."""
    return spark.read.schema(schema).parquet(f"{path}/*") if _exists(spark, path) else spark.createDataFrame([], schema)


def captures_stream(spark: SparkSession, path: str) -> DataFrame:
    """Capture files that land at path, each as (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


@dataclass
class Engine:
    """Runs batches of events through the lanes: start, subscribe, pause, resume, metrics, health, stop.

    home is a folder that all executors share; it gets Parquet tables (events, alerts, dead letters, counts) and the
    engine's state: what deduplication remembers, open windows with the events that wait in them, and unfinished
    frames. A batch is written under its number and reads the state that the one before has left, so one that is
    repeated after a failure replaces itself, and an engine that starts again goes on where it was.

    Events of the batch lane are stored and delivered when their window closes, or at stop().
    """

    topics: DataFrame
    home: str
    registry: Registry = field(default_factory=default_registry)
    subscriptions: Subscriptions = field(default_factory=Subscriptions)
    alerts: Alerts = field(default_factory=Alerts)
    processors: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    key: str = "id"
    ttl_us: int = lanes.DEDUP_TTL_US
    window_us: int = WINDOW_US
    max_ms: int = lanes.MAX_PROCESSING_MS
    paused: bool = False
    dropping: bool = False
    query: StreamingQuery | None = None
    last: int = -1

    @property
    def spark(self) -> SparkSession:
        return self.topics.sparkSession

    def pause_transactions(self) -> None:
        self.paused = True

    def resume_transactions(self) -> None:
        self.paused = False

    def drop_batch_events(self) -> None:
        self.dropping = True

    def resume_batch_events(self) -> None:
        self.dropping = False

    def _state(self, name: str, number: int) -> DataFrame | None:
        path = f"{self.home}/state/{number}/{name}"
        return self.spark.read.parquet(path) if number >= 0 and _exists(self.spark, path) else None

    def _write(self, table: DataFrame, name: str, number: int | str) -> None:
        table.write.mode("overwrite").parquet(f"{self.home}/{name}/batch={number}")

    def process(self, events: DataFrame, number: int = 0) -> None:
        """One batch: routed, handled, judged with what is remembered, written, counted, and delivered.

        A lane that processors has a function for is given to it first: it takes and returns the lane's events.
        """
        x = routing.route(events, self.topics)
        for lane, own in self.processors.items():
            x = x.where(F.col("lane") != lane).unionByName(own(x.where(F.col("lane") == lane)), allowMissingColumns=True)
        x = lanes.processed(x, self.registry)
        remembered = self._state("remembered", number - 1)
        told = lanes.fates(x, self.key, self.ttl_us, self.max_ms, self.paused, self.dropping, remembered)
        self._write(told, "told", number)
        told = self.spark.read.parquet(f"{self.home}/told/batch={number}")

        closed, failed = self._windows(told, number)
        done = told.where("stored").where(F.col("lane") != BATCH).unionByName(closed, allowMissingColumns=True)
        letters = dead_letters.dead_letters(told.where("status <> 'failed_at_flush'")).unionByName(dead_letters.dead_letters(failed))
        raised = lanes.alerts(told.where("lane = 'REALTIME'").drop("status", "letter", "processed", "dropped", "stored", "attempts"), self.max_ms)
        for name, table in (("events", done), ("alerts", raised), ("dead_letters", letters), ("counts", metrics.by_component(told))):
            self._write(table, name, number)
        self._remember(told, remembered, number)
        self.subscriptions.notify(self.spark.read.parquet(f"{self.home}/events/batch={number}"))
        self.subscriptions.notify_dropped(self.spark.read.parquet(f"{self.home}/dead_letters/batch={number}"))
        self.alerts.raise_all(self.spark.read.parquet(f"{self.home}/alerts/batch={number}"))
        self.last = number

    def _windows(self, told: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        """The batch lane's events whose windows have closed: those stored, and those that failed then."""
        here = told.where((F.col("lane") == BATCH) & (F.col("processed") == 1))
        waiting, anchors = self._state("waiting", number - 1), self._state("anchors", number - 1)
        numbered = anchored.anchored_windows(here, "topic", "arrival_us", "id", self.window_us, anchors)
        whole = numbered if waiting is None else numbered.unionByName(waiting, allowMissingColumns=True)
        path = f"{self.home}/state/{number}"
        slim = here.select(F.col("topic").alias("key"), F.col("arrival_us").alias("time"), "id", F.lit(True).alias("ok"))
        found = anchored.last_points(slim, self.window_us, anchors)
        found.write.mode("overwrite").parquet(f"{path}/anchors")
        latest = self.spark.read.parquet(f"{path}/anchors").select(F.col("key").alias("topic"), F.col("number").alias("__number"))
        whole = whole.join(latest, "topic", "left")
        open_ = F.col("window") >= F.col("__number")
        whole.where(open_).drop("__number").write.mode("overwrite").parquet(f"{path}/waiting")
        over = whole.where(~open_).drop("__number", "window", "flushed")
        return over.where("stored"), over.where("status = 'failed_at_flush'")

    def _remember(self, told: DataFrame, before: DataFrame | None, number: int) -> None:
        """What a later duplicate may be compared with: each key's last success, while its time to live lasts."""
        new = told.where("lane = 'TRANSACTIONAL' and status = 'processed'").select(
            F.col(self.key).alias("key"), F.struct(F.col("arrival_us").alias("time"), "id").alias("at")
        )
        if before is not None:
            new = new.unionByName(before.select("key", F.struct("time", "id").alias("at")))
        last = new.groupBy("key").agg(F.max("at").alias("at"))
        now = told.agg(F.max("arrival_us").alias("now"))
        live = last.crossJoin(F.broadcast(now)).where(F.col("now").isNull() | (F.col("at.time") + self.ttl_us >= F.col("now")))
        live.select(
            "key", "at.time", "at.id", F.lit(0).cast("long").alias("number")
        ).write.mode("overwrite").parquet(f"{self.home}/state/{number}/remembered")

    def process_captures(self, captures: DataFrame, number: int = 0, connection=None) -> None:
        """One batch of capture files: split into frames with what was unfinished before, decoded, made events, processed.

        connection is a column over path that tells which files are one byte stream, in order of path; each file is
        a stream of its own without it.
        """
        name = F.col("path") if connection is None else connection
        parts = captures.select(name.alias("connection"), F.col("path"), "modificationTime", "content")
        got = frames.split_connections(parts, self._state("tails", number - 1))
        got.write.mode("overwrite").parquet(f"{self.home}/frames/batch={number}")
        got = self.spark.read.parquet(f"{self.home}/frames/batch={number}")
        got.where("tail is not null").select("connection", "tail", "gave_up").write.mode("overwrite").parquet(f"{self.home}/state/{number}/tails")
        decoded = frames.decode_body(got.where("body is not null"), "body")
        self.process(model.from_frames(decoded.drop("body", "tail", "gave_up")), number)

    def start(self, stream: DataFrame, checkpoint: str, captures: bool = False, connection=None, **trigger) -> StreamingQuery:
        """Starts on a stream of events, or of capture files."""
        step = (lambda b, n: self.process_captures(b, n, connection)) if captures else self.process
        self.query = stream.writeStream.foreachBatch(lambda b, n: step(b, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        return self.query

    def table(self, name: str) -> DataFrame:
        """All batches of events, alerts, dead_letters, counts, or frames."""
        return self.spark.read.parquet(f"{self.home}/{name}").drop("batch")

    def metrics(self) -> DataFrame:
        """(component, processed, dropped, queue_depth, last_event_us) of all batches so far; queue_depth is what waits in open windows."""
        counts = self.table("counts").groupBy("component").agg(
            F.sum("processed").alias("processed"), F.sum("dropped").alias("dropped"), F.max("last_event_us").alias("last_event_us")
        )
        waiting = self._state("waiting", self.last)
        depth = F.lit(0).cast("long")
        if waiting is not None:
            depth = F.when(F.col("component") == model.PROCESSORS[BATCH], F.lit(waiting.count()).cast("long")).otherwise(depth)
        return counts.select("component", "processed", "dropped", depth.alias("queue_depth"), "last_event_us")

    def health(self) -> DataFrame:
        return metrics.readiness(self.metrics(), self.query is not None and self.query.isActive)

    def stop(self) -> None:
        """Ends after what is there has been processed, and flushes the open windows."""
        if self.query is not None:
            self.query.processAllAvailable() if self.query.isActive else None
            self.query.stop()
        waiting = self._state("waiting", self.last)
        if waiting is not None:
            rest = waiting.drop("window", "flushed")
            self._write(rest.where("stored"), "events", "rest")
            self._write(dead_letters.dead_letters(rest.where("status = 'failed_at_flush'")), "dead_letters", "rest")
            self.subscriptions.notify(self.spark.read.parquet(f"{self.home}/events/batch=rest"))
