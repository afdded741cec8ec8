"""Components of sets that share a key and pass an exact Jaccard test, without listing all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for b in batches:
            a_ids, b_ids, xs, ys = (b.column(c) for c in ("a", "b", "x", "y"))
            keep = []
            for i in range(b.num_rows):
                if (hub := b_ids[i].as_py()) != last:
                    last, left = hub, np.frombuffer(ys[i].as_buffer(), dtype=np.uint64)
                own = np.frombuffer(xs[i].as_buffer(), dtype=np.uint64)
                at = np.searchsorted(left, own)
                at[at == len(left)] = 0
                both = int((left[at] == own).sum()) if len(left) else 0
                if both and 100 * both >= percent * (len(own) + len(left) - both):
                    keep.append(i)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a_ids.take(kept), b_ids.take(kept)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets (id, items) have 100 * intersection >= percent * union."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


PIVOTS = 8
BLOCK = 64


def _compare_blocks(percent: int) -> Callable:
    """Links between two blocks of sets that are in different components, by counting common items, a set at a time."""

    def load(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, inside = (np.array([x[k].as_py() for x in block], dtype=np.int64) for k in ("id", "inside"))
        sets = [np.frombuffer(x["items"].as_buffer(), dtype=np.uint64) for x in block]
        return ids, inside, np.array([len(x) for x in sets], dtype=np.int64), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for xs, ys in zip(b.column("xs"), b.column("ys"), strict=True):
                (xi, xin, xn, xsets), (yi, yin, yn, ysets) = load(xs), load(ys)
                xt, xo = np.concatenate(xsets), np.repeat(np.arange(len(xi)), xn)
                order = np.argsort(xt, kind="stable")
                xt, xo = xt[order], xo[order]
                one, two = [], []
                for j, y in enumerate(ysets):
                    may = (xin != yin[j]) & (100 * np.minimum(xn, yn[j]) >= percent * np.maximum(xn, yn[j]))
                    if not may.any():
                        continue
                    low, high = np.searchsorted(xt, y, "left"), np.searchsorted(xt, y, "right")
                    c = high - low
                    at = np.repeat(low - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
                    both = np.bincount(xo[at], minlength=len(xi))
                    hit = np.flatnonzero(may & (both > 0) & (100 * both >= percent * (xn + yn[j] - both)))
                    one.append(np.maximum(xi[hit], yi[j])), two.append(np.minimum(xi[hit], yi[j]))
                none = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *one])), pa.array(np.concatenate([none, *two]))], ["a", "b"])

    return run


def blockwise(xs: DataFrame, ys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of xs and ys (group, id, inside) that share a group and differ in inside.

    Each side's members of a group are dealt by hash into blocks of about BLOCK sets; a row holds two blocks, so
    all of a group is compared exactly by few rows, none of which grows with the group.
    """

    def blocks(m: DataFrame, name: str) -> DataFrame:
        count = m.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        x = m.join(count, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
        return x.groupBy("group", "block").agg(F.collect_list(F.struct("id", "inside", "items")).alias(name)).drop("block")

    return blocks(xs, "xs").join(blocks(ys, "ys"), "group").select("xs", "ys").mapInArrow(_compare_blocks(percent), "a long, b long").distinct()


def groups_of(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, an, b, bn): the smallest id of each key, b, with each other id of the key, a, and their sets' sizes.

    keyed is (id, n, key). What has a row with the same b is a group; a key of one id alone gives no row.
    """
    hubs = keyed.groupBy("key").agg(
        F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("other")
    ).where("hub.id <> other").select("key", F.col("hub.id").alias("b"), F.col("hub.n").alias("bn"))
    return scratch.table(keyed.join(hubs, "key").where("id <> b").select(F.col("id").alias("a"), F.col("n").alias("an"), "b", "bn").distinct())


def members_of(groups: DataFrame) -> DataFrame:
    """(id): the ids of groups, once each."""
    return groups.select(F.col("a").alias("id")).unionByName(groups.select(F.col("b").alias("id"))).distinct()


def link_components(first: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the ids that have a confirmed link, from groups_of() and the members' sets (id, items).

    Candidates are confirmed on whole sets, sorted 64-bit hashes as bytes, in three rounds, with components after
    each: every id against its least hub; ids that are still apart from hubs against one of each of these's components
    and PIVOTS members of its group, drawn by hash; and what is apart even then against all of the group, its hub too, block by block. So a
    candidate pair is connected already or compared itself, no link between candidates is lost, and a group of
    copies costs a few comparisons a member.
    """

    def links(pairs: DataFrame) -> DataFrame:
        """The confirmed ones of pairs (a, an, b, bn)."""
        alike = pairs.where(f"100 * least(an, bn) >= {percent} * greatest(an, bn)")
        return scratch.table(confirmed(alike.select("a", "b").distinct(), sets, percent))

    def members(comp: DataFrame) -> DataFrame:
        """The groups with each id's component; an id without one is its own."""
        of = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
        x = first.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return scratch.table(x.select("a", "an", "b", "bn", F.coalesce("a_in", "a").alias("a_in"), F.coalesce("b_in", "b").alias("b_in")))

    def apart(x: DataFrame) -> DataFrame:
        """What is still apart from a hub, once for each component of its hubs, with the least hub of that."""
        x = x.where("a_in <> b_in").groupBy(F.col("a").alias("x"), F.col("an").alias("xn"), F.col("a_in").alias("x_in"), "b_in")
        return x.agg(F.min("b").alias("b")).drop("b_in")

    def pair(x: DataFrame) -> DataFrame:
        return x.select(F.greatest("x", "a").alias("a"), F.least("x", "a").alias("b"), F.col("xn").alias("an"), F.col("an").alias("bn"))

    def merged(comp: DataFrame, found: DataFrame) -> DataFrame:
        """comp, a table, with what the links found add."""
        if found.isEmpty():
            return comp
        return connected_components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found), scratch)

    least = first.groupBy("a", "an").agg(F.min(F.struct("b", "bn")).alias("hub")).select("a", "an", "hub.b", "hub.bn")
    comp = connected_components(links(least), scratch)
    now = members(comp)
    drawn = [F.min(F.struct(F.xxhash64("a", F.lit(k)).alias("h"), "a", "an", "a_in")).alias(f"p{k}") for k in range(PIVOTS)]
    hub = F.first(F.struct(F.lit(0).cast("long").alias("h"), F.col("b").alias("a"), F.col("bn").alias("an"), F.col("b_in").alias("a_in")))
    pivots = now.groupBy("b").agg(*drawn, hub.alias("hub")).select(
        "b", F.array_distinct(F.array("hub", *(f"p{k}" for k in range(PIVOTS)))).alias("p")
    )
    tried = apart(now).join(pivots, "b").select(
        "x", "xn", "x_in", F.explode(F.expr("filter(p, q -> q.a_in <> x_in)")).alias("q")
    ).select("x", "xn", "q.a", "q.an")
    comp = merged(comp, links(pair(tried)))
    then = members(comp)
    xs = scratch.table(then.where("a_in <> b_in").select(F.col("b").alias("group"), F.col("a").alias("id"), F.col("a_in").alias("inside")))
    if xs.isEmpty():
        return comp
    side = lambda c: then.select(F.col("b").alias("group"), F.col(c).alias("id"), F.col(f"{c}_in").alias("inside"))
    ys = side("a").unionByName(side("b").distinct()).join(xs.select("group").distinct(), "group", "left_semi")
    out = merged(comp, scratch.table(blockwise(xs, ys, sets, percent)))
    scratch.drop(now, then, xs)
    return out
