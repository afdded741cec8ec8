"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, component) for each id of edges (a, b): component is the smallest id it reaches.

    Nulls and loops are ignored; an id without an edge has no row. Each round is written to the shared
    folder, so lineage stays short and no edge list comes to the driver. A hub with very many edges is
    aggregated before the shuffle, and its join is one that adaptive execution can split.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, was = scratch.table(e.distinct()), None
    for _ in range(rounds):
        e2 = scratch.table(_small_star(_large_star(e)))
        scratch.drop(e)
        e = e2
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return scratch.table(e.select(
        F.col("u").alias("id"), F.col("v").alias("component")
    ).unionByName(roots.select("id", F.col("id").alias("component"))))
