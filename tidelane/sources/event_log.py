"""The binary event log: records of an event's time, source, id, topic and body. Parquet is the main sink."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.binary import be_bytes, le_bytes


def encode(ts_ns: Column, source: Column, id: Column, topic: Column, body: Column) -> Column:
    """A record: time (8 bytes), source (1), id (4), topic length (4), topic, body length (8), body; little-endian."""
    data = topic.cast("binary")
    return F.concat(le_bytes(ts_ns, 8), be_bytes(source, 1), le_bytes(id, 4), le_bytes(F.length(data), 4), data, le_bytes(F.length(body), 8), body)


def read(data: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(ts_ns, source, id, topic, body) of each whole record; a cut-off tail is left out."""
    at = 0
    while at + 17 <= len(data):
        ts, source, id, size = struct.unpack_from("<QBII", data, at)
        end = at + 17 + size
        if end + 8 > len(data):
            return
        (length,) = struct.unpack_from("<Q", data, end)
        if end + 8 + length > len(data):
            return
        yield ts, source, id, data[at + 17 : end], data[end + 8 : end + 8 + length]
        at = end + 8 + length


def decode(logs: DataFrame, column: str = "content") -> DataFrame:
    """(ts_ns, source_type, id, topic, body) of the records of each log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                rows = list(zip(*read(x.as_py() or b""), strict=True)) or [[]] * 5
                topics = [t.decode("utf-8", "replace") for t in rows[3]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(topics, pa.string()),
                        pa.array(rows[4], pa.binary())
                    ],
                    ["ts_ns", "source_type", "id", "topic", "body"]
                )

    return logs.select(F.col(column).alias("data")).mapInArrow(run, "ts_ns long, source_type int, id long, topic string, body binary")


def find(events: DataFrame, id: int) -> DataFrame:
    """The event of an id; the filter reaches a Parquet scan."""
    return events.where(F.col("id") == id)
