"""The event model: enumerations, schemas, and events derived from an events table."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.binary import be_bytes, le_bytes


class Priority(IntEnum):
    BATCH, LOW, MEDIUM, HIGH, CRITICAL = range(5)


class Source(IntEnum):
    TCP, UDP, FILE, INTERNAL, PLUGIN, PYTHON = range(6)


class AlertLevel(IntEnum):
    INFO, WARNING, CRITICAL, EMERGENCY = range(4)


class Pressure(IntEnum):
    NORMAL, HIGH, CRITICAL = range(3)


REALTIME, TRANSACTIONAL, BATCH = "REALTIME", "TRANSACTIONAL", "BATCH"
PROCESSORS = {REALTIME: "RealtimeProcessor", TRANSACTIONAL: "TransactionalProcessor", BATCH: "BatchProcessor"}

EVENT_SCHEMA = (
    "id bigint, source_type int, priority int, ts_ns bigint, arrival_us bigint, topic string, topic_len int, "
    "body binary, body_len bigint, crc32 bigint, metadata map<string,string>, dequeue_time_ns bigint"
)


def names_of(enum: type[IntEnum], value: Column) -> Column:
    """The member's name; null for other values."""
    out = F.lit(None).cast("string")
    for m in enum:
        out = F.when(value == int(m), m.name).otherwise(out)
    return out


def values_of(enum: type[IntEnum], name: Column) -> Column:
    """The member's value by its exact name; null for other names."""
    out = F.lit(None).cast("int")
    for m in enum:
        out = F.when(name == m.name, int(m)).otherwise(out)
    return out


def build(id: Column, source: Column, priority: Column, arrival_us: Column, topic: Column, body: Column, metadata: Column) -> list[Column]:
    """The columns of a new event: lengths and checksum are those of topic and body; the topic's has 16 bits."""
    return [
        id.cast("long").alias("id"), source.cast("int").alias("source_type"), priority.cast("int").alias("priority"), (arrival_us * 1000).cast("long").alias("ts_ns"), arrival_us.cast("long").alias("arrival_us"), topic.alias("topic"),
        (F.octet_length(topic).cast("long") % 65536).cast("int").alias("topic_len"), body.alias("body"), F.length(body).cast("long").alias("body_len"), F.crc32(body).alias("crc32"), metadata.alias("metadata"), F.lit(0).cast("long").alias("dequeue_time_ns"),
    ]


def topic_of(event_type: Column, user_id: Column) -> Column:
    """A topic for each kind of event and user."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (user_id % len(names) + 1).cast("int"))
    return (
        F.when(event_type == "view", pick("sensor/temperature", "sensor/temperature/room1", "sensor/1"))
        .when(event_type == "error", pick("sensor/pressure", "system/errors", "db/error"))
        .when(event_type == "purchase", pick("payment", "payment/card"))
        .when(event_type == "signup", pick("audit", "state/user"))
        .otherwise(pick("analytics/metrics", "batch/topic_0", "system/info"))
    )


def from_events_table(table: DataFrame) -> DataFrame:
    """Events, with their measures, from a table (event_id, ts, user_id, event_type, value).

    Body: empty for every thirteenth id; for payments the amount, little-endian; else a reading and padding.
    Rows without event_id aren't events.
    """
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    t = table.where("event_id is not null").select(
        F.col("event_id").cast("long").alias("id"), us.alias("us"), "user_id", "value", topic_of(F.col("event_type"), F.col("user_id")).alias("topic")
    )
    id, topic = F.col("id"), F.col("topic")
    reading = (F.floor("value") % 256).cast("long")
    amount = F.when(id % 17 == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("value") * 10000).cast("long"))
    t = t.withColumn(
        "body",
        F.when(id % 13 == 0, F.unhex(F.lit(""))).when(
            F.startswith(topic, F.lit("payment")), le_bytes(amount, 4)
        ).otherwise(F.concat(be_bytes(reading, 1), F.unhex(F.lit("000000"))))
    )
    event = build(
        id, F.lit(0), id % 5, F.col("us"), topic, F.col("body"),
        F.create_map(F.lit("client_address"), F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    )
    return t.select(*event, (id % 9).alias("elapsed_ms"), (id * id + 1).alias("latency_ns"), (id % 50).alias("dedup_id"))


def from_frames(decoded: DataFrame) -> DataFrame:
    """Events of decoded frames (path, seq, modificationTime, priority, topic, payload, error), as they would be on arrival.

    Frames with an error make no event. The id is a hash of path and seq, so it stays the same when files are read
    again; the body is the payload; the arrival is when the file was written.
    """
    ok = decoded.where("error is null")
    us = F.unix_micros("modificationTime")
    event = build(
        F.xxhash64("path", "seq"), F.lit(int(Source.TCP)), F.col("priority"), us, F.col("topic"), F.col("payload"),
        F.create_map(F.lit("client_address"), F.col("path"))
    )
    return ok.select(*event, F.lit(0).cast("long").alias("elapsed_ms"))
