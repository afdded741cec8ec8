"""Chains of points in time, each the first that is a gap or more after the one before, found range by range."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CELLS = 16  # gaps in a range: a chain has one point more there at most
_POINT = "struct<time:bigint,id:bigint,number:bigint>"
_ENDS = (("number", "ending", -1), ("time", "last_time", 0), ("id", "last_id", 0))


def chain_ends(t: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted times, the last point of the chain that begins there, and how many points it has."""
    n = len(t)
    jump = np.searchsorted(t, t + gap, "left")
    last, count = np.arange(n), np.ones(n, dtype=np.int64)
    while len(on := np.flatnonzero(jump < n)):
        to = jump[on]
        last[on], count[on], jump[on] = last[to], count[on] + count[to], jump[to]
    return last, count


def chain_from(t: np.ndarray, gap: int, first: int) -> list[int]:
    """The chain's points from place `first` on."""
    out = []
    while first < len(t):
        out.append(first)
        first = int(np.searchsorted(t, t[first] + gap, "left"))
    return out


def _ends(gap: int, span: int, anywhere: bool):
    """For each range, what a chain that comes to it leaves it with, as a step function of where its next point may be."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            steps = []
            for part, points in zip(f["part"], f["points"], strict=True):
                t = np.array([p["time"] for p in points], dtype=np.int64)
                last, count = chain_ends(t, gap)
                most = len(t) if anywhere else min(  # a chain from an earlier range can't begin later
                    len(t), int(np.searchsorted(t, part * span + gap, "left")) + 1
                )
                new = np.ones(most, dtype=bool)
                new[:-1] = (last[: most - 1] != last[1:most]) | (count[: most - 1] != count[1:most])
                steps.append([{
                    "upto": int(t[i]), "time": int(t[last[i]]), "id": int(points[last[i]]["id"]), "count": int(count[i])
                } for i in np.flatnonzero(new)])
            yield f[["key", "part"]].assign(steps=steps)

    return run


def _fold(gap: int, kind: pa.DataType):
    """Over a key's ranges in order: the chain's point and number with which each begins, and the number at the end.

    Rows come sorted by key and part; only one key's ranges are held at a time.
    """
    point = pa.struct([("time", pa.int64()), ("id", pa.int64()), ("number", pa.int64())])
    schema = pa.schema([
        ("key", kind), ("part", pa.int64()), ("begun", point), ("ending", pa.int64()), ("last_time", pa.int64()), ("last_id", pa.int64())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, begun, done = None, None, [], []

        def end() -> None:
            last = (-1, 0, 0) if at is None else (at["number"], at["time"], at["id"])
            done.extend((key, part, point, *last) for part, point in begun)
            begun.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            done.clear()
            return out

        for b in batches:
            for own, part, steps, carried in zip(*(b.column(c).to_pylist() for c in ("key", "part", "steps", "carried")), strict=True):
                if own != key:
                    end()
                    key, at = own, None
                if carried is not None:
                    at = carried
                begun.append((part, at))
                if steps:
                    k = 0 if at is None else bisect_left(steps, at["time"] + gap, key=lambda s: s["upto"])
                    if k < len(steps):
                        at = {"time": steps[k]["time"], "id": steps[k]["id"], "number": (-1 if at is None else at["number"]) + steps[k]["count"]}
            yield batch()
        end()
        yield batch()

    return run


def _points(gap: int):
    """Each range's chain: the point it begins with, and those in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for points, begun in zip(f["points"], f["begun"], strict=True):
                t = np.array([p["time"] for p in points], dtype=np.int64)
                number = -1 if begun is None else int(begun["number"])
                own = [] if begun is None else [dict(begun)]
                for i in chain_from(t, gap, 0 if begun is None else int(np.searchsorted(t, int(begun["time"]) + gap, "left"))):
                    number += 1
                    own.append({"time": int(t[i]), "id": int(points[i]["id"]), "number": number})
                out.append(own)
            yield f[["key", "part", "ending", "last_time", "last_id"]].assign(chain=out)

    return run


def part_of(time, gap: int):
    """The range of CELLS gaps that a time lies in."""
    return F.floor(time / (CELLS * gap)).cast("long")


def chains(rows: DataFrame, gap: int, carried: DataFrame | None = None) -> DataFrame:
    """(key, part, chain, ending, last_time, last_id) for each range of each key of rows (key, time, id, ok).

    The chain of a key begins with its first row that is ok; each further point is the first one that is gap or more
    later; of rows of one time the smallest id counts. chain lists the points of a range, after the last one
    before it, with their numbers; ending is the number of the key's last point, -1 for none, and last_time and
    last_id are that point's. carried (key, time, id, number) are points with which chains begin instead.

    A key's rows meet only range by range: each range tells where a chain that comes to it leaves it, and only these
    short tables are folded over a key's ranges. A key whose points all lie within gap of the one its chain begins
    with has no other point, so most of many keys need no fold. Null keys and times have no chain.
    """
    kind, span = dict(rows.dtypes)["key"], CELLS * gap
    rows = rows.where("key is not null and time is not null")
    times = rows.groupBy("key", part_of(F.col("time"), gap).alias("part"), "time").agg(F.min(F.when(F.col("ok"), F.col("id"))).alias("id"))
    point = F.when(F.col("id").isNotNull(), F.struct("time", "id"))
    ranges = times.groupBy("key", "part").agg(F.sort_array(F.collect_list(point)).alias("points"))
    own = ranges.groupBy("key").agg(
        F.min(F.get("points", F.lit(0))).alias("first"), F.max(F.try_element_at("points", F.lit(-1)))["time"].alias("upto")
    )
    first = F.when(F.col("first").isNotNull(), F.struct("first.time", "first.id", F.lit(0).cast("long").alias("number")))
    begins = own.select(F.col("key").alias("__own"), first.cast(_POINT).alias("first"), "upto", F.lit(False).alias("begun"), F.lit(1).alias("n"))
    if carried is not None:
        carried = carried.select("key", F.struct(*(F.col(c).cast("long").alias(c) for c in ("time", "id", "number"))).cast(_POINT).alias("carried"))
        given = carried.groupBy(F.col("key").alias("__given")).agg(F.any_value("carried").alias("carried"), F.count(F.lit(1)).alias("given"))
        begins = begins.join(given, F.col("__own") == F.col("__given"), "left").select(
            "__own", F.coalesce("carried", "first").alias("first"), "upto", F.col("carried").isNotNull().alias("begun"), F.coalesce("given", "n").alias("n")
        )
    lone = F.coalesce(F.col("upto") - F.col("first.time") < gap, F.lit(True)) & (F.col("n") == 1)
    ranges = ranges.join(begins.select("__own", "first", "begun", lone.alias("lone")), F.col("key") == F.col("__own")).drop("__own")
    there = F.col("first").isNotNull() & (F.col("begun") | (F.col("part") >= part_of(F.col("first.time"), gap)))
    alone = ranges.where("lone").select(
        "key", "part", *(F.coalesce(F.col(f"first.{c}"), F.lit(none).cast("long")).alias(name) for c, name, none in _ENDS),
        F.when(there, F.array("first")).otherwise(F.array()).cast(f"array<{_POINT}>").alias("chain")
    )
    ranges = ranges.where("not lone").select("key", "part", "points")
    steps = ranges.mapInPandas(
        _ends(gap, span, carried is not None), f"key {kind}, part bigint, steps array<struct<upto:bigint,time:bigint,id:bigint,count:bigint>>"
    ).withColumn("carried", F.lit(None).cast(_POINT))
    if carried is not None:
        before = F.lit(-(1 << 62)).cast("long").alias("part")
        steps = steps.unionByName(carried.join(ranges.select("key").distinct(), "key", "left_semi").select(
            "key", before, F.lit(None).cast("array<struct<upto:bigint,time:bigint,id:bigint,count:bigint>>").alias("steps"), "carried"
        ))
    begun = steps.repartition("key").sortWithinPartitions("key", "part").mapInArrow(
        _fold(gap, to_arrow_type(rows.schema["key"].dataType)), f"key {kind}, part bigint, begun {_POINT}, ending bigint, last_time bigint, last_id bigint"
    )
    both = ranges.join(begun, ["key", "part"])
    return alone.unionByName(both.mapInPandas(
        _points(gap), f"key {kind}, part bigint, ending bigint, last_time bigint, last_id bigint, chain array<{_POINT}>"
    ))


def with_chain(rows: DataFrame, key: str, time: str, id: str, ok, gap: int, carried: DataFrame | None = None) -> DataFrame:
    """rows with the last points of their key's chain before them (__before) and up to them (__at), its last number (__ending), and the first that their range knows (__first)."""
    slim = rows.select(F.col(key).alias("key"), F.col(time).cast("long").alias("time"), F.col(id).cast("long").alias("id"), ok.alias("ok"))
    found = chains(slim, gap, carried).select(F.col("key").alias("__key"), F.col("part").alias("__part_of"), "chain", "ending")
    x = rows.withColumn("__part", part_of(F.col(time), gap)).join(
        found, (F.col(key) == F.col("__key")) & (F.col("__part") == F.col("__part_of")), "left"
    )
    own = F.struct(F.col(time).cast("long").alias("time"), F.col(id).cast("long").alias("id"))
    upto = lambda op: F.element_at(F.filter("chain", lambda p: op(F.struct(p["time"].alias("time"), p["id"].alias("id")), own)), -1)
    none = F.coalesce(F.size("chain"), F.lit(0)) <= 0
    pick = lambda op: F.when(
        ~none & (F.size(F.filter("chain", lambda p: op(F.struct(p["time"].alias("time"), p["id"].alias("id")), own))) > 0), upto(op)
    )
    return x.withColumns({
        "__before": pick(lambda a, b: a < b), "__at": pick(lambda a, b: a <= b), "__ending": F.col("ending"),
        "__first": F.when(~none, F.element_at("chain", 1))
    }).drop(
        "__part", "__key", "__part_of", "chain", "ending"
    )
