"""Length-prefixed frames: decoding and encoding as columns, and splitting of byte streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.binary import be_bytes, be_uint

MAX_FRAME = 10 * 1024 * 1024
MAX_EMPTY = 10
# The wording of errors.
SHORT_BODY = "Frame too small: missing priority or topic_len"
BAD_PRIORITY = "Invalid priority value"
SHORT_TOPIC = "Frame too small for declared topic length"
NO_TOPIC = "Topic length cannot be zero"
SHORT_FRAME = "Frame too small: missing length prefix"
MISMATCH = "Frame length mismatch"


def _rest(body: Column, skip: Column) -> Column:
    return F.substr(body, skip + 1, F.greatest(F.length(body) - skip, F.lit(0)).cast("int"))


def decode_body(df: DataFrame, column: str) -> DataFrame:
    """df with error, priority, topic and payload of a frame's body; error is null where the others are set.

    Body: priority, topic length in two bytes, topic, payload. A topic that isn't UTF-8 is decoded with
    replacements; topic_bytes keeps it as it is.
    """
    body = F.col(column)
    size = be_uint(body, 2, 2)
    error = F.when(F.length(body) < 3, SHORT_BODY).when(be_uint(body, 1, 1) > 4, BAD_PRIORITY).when(F.length(body) < 3 + size, SHORT_TOPIC).when(size == 0, NO_TOPIC)
    x = df.withColumn("error", F.when(body.isNull(), SHORT_BODY).otherwise(error))
    ok = F.col("error").isNull()
    topic = F.when(ok, F.substr(body, F.lit(4), size.cast("int")))
    text = F.call_function("try_validate_utf8", topic.cast("string"))
    return x.withColumns({
        "priority": F.when(ok, be_uint(body, 1, 1).cast("int")), "topic": F.when(
            ok, F.coalesce(text, F.call_function("make_valid_utf8", topic.cast("string")))
        ), "topic_bytes": topic, "payload": F.when(ok, _rest(body, (size + 3).cast("int"))),
    })


def decode_frame(df: DataFrame, column: str) -> DataFrame:
    """df with error, priority, topic and payload of a whole frame: its length in four bytes, and its body."""
    frame = F.col(column)
    wrong = F.when(frame.isNull() | (F.length(frame) < 4), SHORT_FRAME).when(be_uint(frame, 1, 4) != F.length(frame) - 4, MISMATCH)
    x = decode_body(df.withColumns({"__wrong": wrong, "__body": _rest(frame, F.lit(4))}), "__body")
    ok = F.col("__wrong").isNull()
    columns = {c: F.when(ok, F.col(c)) for c in ("priority", "topic", "topic_bytes", "payload")}
    return x.withColumns({"error": F.coalesce("__wrong", "error"), **columns}).drop("__wrong", "__body")


def decode_datagram(df: DataFrame, column: str) -> DataFrame:
    """df with the first frame of each datagram; what follows it is ignored."""
    data = F.col(column)
    size = be_uint(data, 1, 4)
    wrong = F.when(data.isNull() | (F.length(data) < 8), SHORT_FRAME).when((size == 0) | (size + 4 > F.length(data)), MISMATCH)
    x = decode_body(df.withColumns({"__wrong": wrong, "__body": F.when(wrong.isNull(), F.substr(data, F.lit(5), size.cast("int")))}), "__body")
    return x.withColumn("error", F.coalesce("__wrong", "error")).drop("__wrong", "__body")


def encode(priority: Column, topic: Column, payload: Column) -> Column:
    """A whole frame."""
    body = F.concat(be_bytes(priority, 1), be_bytes(F.octet_length(topic), 2), topic.cast("binary"), payload)
    return F.concat(be_bytes(F.length(body), 4), body)


def split_stream(data: bytes, empty: int = 0) -> tuple[list[bytes], bytes, bool, int]:
    """Bodies of the frames in data, the unfinished tail, whether the connection is given up, and its empty frames in a row.

    Empty frames are skipped; one more than MAX_EMPTY in a row, or a frame of over MAX_FRAME, gives it up. empty is
    how many came just before data.
    """
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size == 0:
            empty += 1
            at += 4
            if empty > MAX_EMPTY:
                return out, b"", True, empty
            continue
        empty = 0
        if size > MAX_FRAME:
            return out, b"", True, 0
        if at + 4 + size > len(data):
            break
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, data[at:], False, empty


_CONNECTIONS = "connection string, path string, modificationTime timestamp, seq long, body binary, tail binary, gave_up boolean"


def split_connections(parts: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Frames of byte streams that come in parts (connection, path, modificationTime, content), in order of path.

    A row for each frame, with its number within its part in seq and its body; and one for each connection with
    tail, the unfinished rest after the last part, and gave_up, after which a connection's bytes are thrown away.
    tails (connection, tail, gave_up) is what earlier parts have left. A part that continues a frame gives it. Of
    a connection only one part is in memory at a time; a null content is empty.
    """
    x = parts.select("connection", "path", "modificationTime", "content", F.lit(False).alias("gave_up"), F.lit(1).alias("turn"))
    if tails is not None:
        x = x.unionByName(tails.select(
            "connection", F.lit("").alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.col("tail").alias("content"), "gave_up",
            F.lit(0).alias("turn")
        ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, bytes, bool, int] | None = None  # connection, rest, given up, empty frames in a row

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["connection", "path", "modificationTime", "seq", "body", "tail", "gave_up"]
            )

        end = lambda: [(now[0], None, None, None, None, now[1], now[2])] if now else []
        for b in batches:
            for r in b.select(["connection", "path", "modificationTime", "content", "gave_up", "turn"]).to_pylist():
                found = []
                if now is None or now[0] != r["connection"]:
                    found += end()
                    now = (r["connection"], b"", False, 0)
                if r["turn"] == 0:
                    now = (now[0], r["content"] or b"", r["gave_up"], 0)
                elif not now[2]:
                    bodies, rest, gave_up, empty = split_stream(now[1] + (r["content"] or b""), now[3])
                    now = (now[0], rest, gave_up, empty)
                    found += [(r["connection"], r["path"], r["modificationTime"], k, body, None, None) for k, body in enumerate(bodies)]
                yield rows(found)
        yield rows(end())

    return x.repartition("connection").sortWithinPartitions("connection", "turn", "path").mapInArrow(run, _CONNECTIONS)


def split_captures(captures: DataFrame, column: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keep, seq, body): a row for each frame of each captured stream, as of binaryFile. Works in streams, too.

    Each capture is a stream of its own here; split_connections() puts together what goes over several.
    """
    kinds = dict(captures.dtypes)
    slim = captures.select(*keep, F.col(column).alias("__data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bodies = split_stream(b.column("__data")[i].as_py() or b"")[0]
                kept = [b.column(k).take(pa.array([i] * len(bodies), pa.int64())) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(range(len(bodies)), pa.int64()), pa.array(bodies, pa.binary())], [*keep, "seq", "body"]
                )

    return slim.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "seq long", "body binary"]))
