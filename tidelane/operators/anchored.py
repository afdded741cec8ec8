"""Keyed folds over arrival time: windows anchored at their first event, and duplicates within a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import chains, with_chain

NEVER, FOREVER = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


def anchored_numbers(t: np.ndarray, width: int, anchor: int | None = None, number: int = 0) -> tuple[np.ndarray, int | None, int]:
    """The window of each sorted time, and the anchor and number of the window that stays open.

    The first time anchors a window. The one that is width or more after the anchor closes the window, belongs to
    it, and anchors the next. Each window is found by one search, so the fold takes as many steps as windows.
    """
    out, at = np.empty(len(t), dtype=np.int64), 0
    while at < len(t):
        if anchor is None:
            anchor = int(t[at])
        end = at + int(np.searchsorted(t[at:], anchor + width, "left"))
        out[at : min(end + 1, len(t))] = number
        if end < len(t):
            anchor, number = int(t[end]), number + 1
        at = end + 1
    return out, anchor, number


def anchored_windows(events: DataFrame, key: str, time: str, id: str, width: int, carried: DataFrame | None = None) -> DataFrame:
    """events with window and flushed: windows of each key; the last one stays open until a later event or stop.

    The first event of a key anchors a window; the first one that is width or more after the anchor closes it,
    belongs to it, and anchors the next. Events count in order of time and id. carried (key, time, id, number)
    are anchors of windows that are open from before; what comes late, with a time before that, joins these. Events
    without key or time have no window.
    """
    x = with_chain(events, key, time, id, F.lit(True), width, carried)
    number = F.coalesce(F.col("__before.number"), F.col("__at.number"), F.col("__first.number"))
    return x.withColumns({"window": number, "flushed": number < F.col("__ending")}).drop("__before", "__at", "__ending", "__first")


def last_points(rows: DataFrame, gap: int, carried: DataFrame | None = None) -> DataFrame:
    """(key, time, id, number): the last point of each key's chain, of rows (key, time, id, ok) and what is carried."""
    found = chains(rows, gap, carried).where("ending >= 0").groupBy("key").agg(F.max(F.struct("ending", "last_time", "last_id")).alias("p"))
    found = found.select("key", F.col("p.last_time").alias("time"), F.col("p.last_id").alias("id"), F.col("p.ending").alias("number"))
    if carried is not None:
        found = found.unionByName(carried.select("key", "time", "id", "number")).groupBy("key").agg(F.max_by(
            F.struct("time", "id", "number"), "number"
        ).alias("p")).select("key", "p.*")
    return found


def tumbling_windows(events: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """events with window: fixed windows of width, as an alternative that needs no state."""
    return events.withColumn("window", F.floor(F.col(time) / width).cast("long"))


def dedup_status(t: np.ndarray, ok: np.ndarray, ttl: int, last: int | None = None) -> tuple[list[str], int | None]:
    """processed, duplicate or failed for each sorted time: a duplicate is within ttl of the last processed one."""
    out = []
    for at, good in zip(t.tolist(), ok.tolist(), strict=True):
        if last is not None and at - last <= ttl:
            out.append("duplicate")
        elif good:
            out.append("processed")
            last = at
        else:
            out.append("failed")
    return out, last


def dedup(events: DataFrame, key: str, time: str, id: str, ok: Column, ttl: int | None, carried: DataFrame | None = None) -> DataFrame:
    """events with status: processed, duplicate or failed. Only a processed event is remembered, so one that failed may be sent again.

    A duplicate is within ttl of the key's last processed event; ttl None remembers for ever. Events count in order
    of time and id, and rows that agree in key, time and id are one event that came more than once: the first is
    processed. carried (key, time, id, number) are events processed before these; one that comes late, with a time
    before that, is a duplicate. An event without key or time is never one.
    """
    good = F.coalesce(ok, F.lit(False))
    copy = F.row_number().over(Window.partitionBy(key, time, id).orderBy(F.lit(0)))
    if ttl is None:
        point = lambda t, i, n: F.struct(
            F.col(t).cast("long").alias("time"), F.col(i).cast("long").alias("id"), F.lit(n).cast("long").alias("number")
        )
        first = events.select(F.col(key).alias("__key"), F.when(good, point(time, id, 0)).alias("__at"))
        if carried is not None:
            first = first.unionByName(carried.select(F.col("key").alias("__key"), point("time", "id", -1).alias("__at")))
        first = first.groupBy("__key").agg(F.min("__at").alias("__at"))
        x = events.join(first, F.col(key) == F.col("__key"), "left").drop("__key")
        within, late = F.lit(True), F.lit(False)
    else:
        before = None if carried is None else carried.withColumn("number", F.lit(-1).cast("long"))
        x = with_chain(events, key, time, id, good, ttl + 1, before).drop("__before", "__ending")
        late = good & F.col("__first").isNotNull() & F.col("__at").isNull()
        within = F.col(time) - F.col("__at.time") <= ttl
    x = x.withColumn("__copy", copy)
    same = (F.col("__at.time") == F.col(time)) & (F.col("__at.id") == F.col(id))
    before = F.col("__at").isNotNull() & (F.struct(F.col("__at.time"), F.col("__at.id")) < F.struct(
        F.col(time).cast("long").alias("time"), F.col(id).cast("long").alias("id")
    ))
    status = F.when(
        same & good & (F.col("__at.number") >= 0) & (F.col("__copy") == 1), "processed"
    ).when((same | before) & within | late, "duplicate").when(good, "processed").otherwise("failed")
    return x.withColumn("status", status).drop("__at", "__copy", "__first")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of sorted rows as one packed block, with its place in the order of all."""
    part, place = TaskContext.get().partitionId(), 0
    for b in batches:
        if b.num_rows:
            rows = pa.RecordBatch.from_arrays([b["time"], b["id"], b["key"].dictionary_encode(), b["ok"]], ["time", "id", "key", "ok"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([place], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["part", "place", "block"]
            )
            place += 1


class LastTimes:
    """When keys were last processed, in 16 bytes a key; few recent ones wait in a dictionary until they are sorted in."""

    def __init__(self) -> None:
        self.keys, self.times, self.recent = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The times of keys, NEVER for those that aren't known."""
        out = np.full(len(keys), NEVER)
        at, there = self._places(keys)
        out[there] = self.times[at[there]]
        for i in np.flatnonzero(~there) if self.recent else ():
            out[i] = self.recent.get(int(keys[i]), NEVER)
        return out

    def set(self, keys: np.ndarray, times: np.ndarray, limit: int) -> None:
        """New times of different keys; what is older than limit may go."""
        at, there = self._places(keys)
        self.times[at[there]] = times[there]
        self.recent.update(zip(keys[~there].tolist(), times[~there].tolist(), strict=True))
        if len(self.recent) > 10_000 + len(self.keys) // 8:
            keep, new = self.times >= limit, np.array(sorted(self.recent.items()), dtype=np.int64)
            old = self.keys[keep]
            at = np.searchsorted(old, new[:, 0])
            self.keys, self.times, self.recent = np.insert(old, at, new[:, 0]), np.insert(self.times[keep], at, new[:, 1]), {}

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there


def _values(column: pa.Array) -> list:
    """The column's values; by way of numpy, which is much faster, where none is missing."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _free(ttl: int, every: int):
    """Of packed blocks in order, the events that are found free: not remembered when they come. Copies are told once.

    A clean-up takes what is older than ttl, and later ones come later, so a key is remembered while its last processed
    event is no more than ttl before the last clean-up. While all keys of a block are remembered nothing changes
    in it, so the block is passed over; only one block and the keys' times are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, cleaned, limit, before = LastTimes(), None, NEVER + 1, None
        for packed in (block for b in batches for block in b["block"]):
            rows = pa.ipc.open_stream(packed.as_buffer()).read_next_batch()
            code, keys = rows["key"].indices, rows["key"].dictionary.to_numpy()
            last = seen.of(keys)
            if not code.null_count and (last >= limit).all():
                continue
            none, names, own = len(keys), [*keys.tolist(), None], [*last.tolist(), NEVER]
            places, changed = [], set()
            columns = (_values(x) for x in (code.fill_null(none), rows["time"], rows["id"], rows["ok"]))
            for i, (k, t, number, good) in enumerate(zip(*columns, strict=True)):
                if own[k] >= limit:
                    continue
                if t is not None and (cleaned is None or t - cleaned >= every):
                    cleaned, limit = t, max(t - ttl, NEVER + 1)
                event = (t, number, names[k])
                if event != before:
                    places.append(i)
                    before = event
                if good and k != none:
                    own[k] = FOREVER if t is None else t
                    changed.add(k)
            at = np.array(sorted(changed), dtype=np.int64)
            seen.set(keys[at], np.array(own, dtype=np.int64)[at], limit)
            found = rows.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [found["time"], found["id"], found["key"].dictionary_decode(), found["ok"]], ["time", "id", "key", "good"]
            )

    return run


def lazy_dedup(events: DataFrame, key: str, time: str, id: str, ok: Column, ttl: int, every: int) -> DataFrame:
    """(key, id, time, status) with lookups that ignore age: entries leave only at a clean-up.

    A clean-up comes with an event that is no duplicate, `every` or more after the one before, and takes
    entries of over ttl. Events count in order of time and id, those without one last; rows that agree in key,
    time and id are one event that came more than once, of which one that is ok comes first. An event without
    key is never a duplicate, one without time makes no clean-up.

    Clean-ups depend on the whole stream's order, so one task takes the sorted events, packed in blocks, and tells
    which are found free (`_free`); sorting, packing and the status of each event are spread over all tasks.
    """
    event = F.struct(*(F.col(c).cast("long").alias(name) for c, name in ((time, "time"), (id, "id"), (key, "key"))))
    slim = events.select(event.alias("event"), F.coalesce(ok, F.lit(False)).alias("ok"))
    order = [F.col(c).asc_nulls_last() for c in ("time", "id", "key")]
    blocks = slim.select("event.*", "ok").repartitionByRange(*order).sortWithinPartitions(*order, F.col("ok").desc()).mapInArrow(
        _blocks, "part long, place long, block binary"
    )
    free = blocks.repartition(1).sortWithinPartitions("part", "place").mapInArrow(
        _free(ttl, every), "time long, id long, key long, good boolean"
    ).select(F.struct("time", "id", "key").alias("free"), "good")
    copy = F.row_number().over(Window.partitionBy("event").orderBy(F.col("ok").desc()))
    x = slim.withColumn("copy", copy).join(free, F.col("event") == F.col("free"), "left")
    alone = F.when(F.col("ok"), "processed").otherwise("failed")
    status = F.when(F.col("free").isNull(), "duplicate").when(F.col("event.key").isNull(), alone).when(~F.col("good"), "failed").when(
        F.col("ok") & (F.col("copy") == 1), "processed"
    ).otherwise("duplicate")
    return x.select("event.key", "event.id", "event.time", status.alias("status"))
