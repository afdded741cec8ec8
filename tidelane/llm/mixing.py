"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
REPEATS = 3


def n_words(text: Column) -> Column:
    """Count of `[^\\x20\\x09-\\x0D]+` in text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rank, target, budget) from sizes (source, size).

    Sources by code point, null last, take the weights in turn. All sizes together are the budget; a target
    stops at repeats * source_size, and what it leaves goes to the others by weight. A source is at its limit
    if, with sources ordered by limit over weight, the budget that the ones before it leave gives it as much.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = of.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    x = ranked.select("*", w.alias("w"), (F.col("source_size") * repeats).cast("decimal(38,0)").alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("decimal(38,0)")
    x = x.withColumns({
        "budget": F.sum("source_size").over(every).cast("decimal(38,0)"), "all_w": F.sum("w").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), none), "w_before": F.coalesce(F.sum("w").over(before), none)
    })
    full = F.col("cap").cast("double") * (F.col("all_w") - F.col("w_before")).cast("double") <= (F.col("budget") - F.col("cap_before")).cast("double") * F.col("w").cast("double")
    x = x.withColumn("full", full)
    x = x.withColumns({
        "left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(none)).over(every),
        "left_w": F.sum(F.when(F.col("full"), none).otherwise(F.col("w"))).over(every)
    })
    target = F.when(
        F.col("full"), F.col("cap").cast("double")
    ).otherwise(F.col("left").cast("double") * F.col("w").cast("double") / F.col("left_w").cast("double"))
    return x.select("source", "source_size", "rank", target.alias("target"), F.col("budget").cast("long").alias("budget"))


def mix(
    sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix", bucket_rows: int = 2000
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of sizes.

    Each source's documents are shuffled by a digest of doc_id and queued as often as its target needs, up to
    `repeats` passes. A copy's virtual finish time is the source's cumulative size up to it, over the target;
    all copies are ordered by it over all sources, and taken as long as their total is within the budget.
    Running sums are taken in two levels, within buckets of about bucket_rows rows and over the buckets'
    totals, so neither a source that holds most rows nor the global order meets in one task. Rows that agree
    in doc_id, source and size are peers and taken alike. Null sizes aren't allowed; rows of size 0 take
    nothing but keep their place. An empty table gives an empty result.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sizes.count()
    digits = min(8, max(1, math.ceil(math.log(max(rows, 1) / bucket_rows, 16)))) if rows > bucket_rows else 1
    queued = sizes.withColumn("h", digest).withColumn("bucket", F.substring("h", 1, digits))
    sums = queued.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset")
    )
    targets = source_targets(sums.withColumnRenamed("s", "size"), weights, repeats)
    x = queued.withColumn("within", F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "size")))
    x = x.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    t = targets.withColumnRenamed("source", "t_source")
    x = x.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    passes = F.when(
        F.col("source_size") > 0, F.least(F.lit(repeats), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    ).otherwise(1)
    x = scratch.table(x.select(
        "doc_id", "source", "size", "source_size", "rank", "target", "budget", "h", (F.col("offset") + F.col("within")).alias("cum"),
        passes.alias("passes")
    ))
    finish = lambda e: F.when(
        F.col("target") > 0, (e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")
    ).otherwise(F.lit(0.0))
    key = lambda e: F.struct(
        finish(e).alias("finish"), F.col("rank").alias("rank"), F.col("h").alias("h"), F.col("size").alias("size"), e.cast("int").alias("pass")
    )
    copies = x.select("budget", F.explode(F.transform(F.sequence(F.lit(0), F.col("passes") - 1), key)).alias("k"))
    steps = max(1024, min(1_000_000, rows // bucket_rows))
    copies = copies.withColumn("step", F.least(F.floor(F.col("k.finish") * steps), F.lit(2 * steps)))
    totals = copies.groupBy("step").agg(F.sum("k.size").alias("s"), F.max("budget").alias("budget"))
    run = totals.withColumn("end", F.sum("s").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    edge = run.where("end > budget").orderBy("step").select("step", (F.col("end") - F.col("s")).alias("start")).limit(1).collect()
    take = F.col("passes")
    if edge:
        order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("step") == edge[0].step).withColumn(
            "end", F.sum("k.size").over(order) + F.lit(edge[0].start)
        ).where("end <= budget").agg(F.max("k").alias("k")).first().k
        limit = [F.lit(edge[0].step / steps), F.lit(-1), F.lit(""), F.lit(0).cast("long"), F.lit(-1)] if last is None else [
            F.lit(last.finish), F.lit(last.rank), F.lit(last.h), F.lit(last.size).cast("long"), F.lit(last["pass"])
        ]
        cut = F.struct(*(v.alias(n) for v, n in zip(limit, ("finish", "rank", "h", "size", "pass"), strict=True)))
        take = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.col("passes") - 1), key), lambda k: k <= cut))
    return x.select("doc_id", "source", "size", "source_size", "target", take.cast("int").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay as they are."""
    taken = mix(scratch.table(sized(docs)), scratch, **options).where("copies > 0").select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "copies"
    ).distinct()
    row = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), n_words(F.col("text")).alias("d_size")
    )
    same = F.col("d_id").eqNullSafe(F.col("m_id")) & F.col("d_source").eqNullSafe(F.col("m_source")) & (F.col("d_size") == F.col("m_size"))
    return row.join(taken, same).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole documents table."""
    scratch = Scratch(spark, "op2")
    sizes = scratch.table(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mix(sizes, scratch).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS w, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_on
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(cap AS DOUBLE) * w_on <= CAST(budget - cap_before AS DOUBLE) * w AS at_cap FROM o),
t AS (SELECT source, source_size, rank, budget, CASE WHEN at_cap THEN CAST(cap AS DOUBLE) ELSE
      CAST(budget - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / CAST(sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
q AS (SELECT d.*, source_size, rank, budget, target, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY h, size) AS cum,
      CASE WHEN source_size > 0 THEN least(3, greatest(1, CAST(ceil(target / source_size) AS INT))) ELSE 1 END AS passes FROM q),
e AS (SELECT *, CASE WHEN target > 0 THEN CAST(p * source_size + cum AS DOUBLE) / target ELSE 0 END AS finish
      FROM c, unnest(range(passes)) AS u(p)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, h, size, p ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN run <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target
"""
