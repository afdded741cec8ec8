"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefilter
from . import shingles as sh
from .components import connected_components
from .linking import groups_of, link_components, members_of
from .scratch import Scratch

HALVES = 16
ROWS = 4


def _features(size: int, halves: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sh.constants(seed, 2 * halves * rows)
        for b in batches:
            for at, to, words in sh.chunks(b):
                x, n = sh.shingles(words.hashes(), words.docs, size)
                has = n > 0
                one, two = (pa.array(d, mask=~has) for d in sh.digests(x, n))
                keys = sh.keys(x, n[has], c, rows) if has.any() else np.zeros((0, 2 * halves), np.int64)
                ends = np.append(0, np.cumsum(has) * 2 * halves).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), pa.array(n.astype(np.int64)), one, two, lists],
                    ["doc_id", "n_shingles", "fp1", "fp2", "halves"]
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, words in sh.chunks(b):
                x, n = sh.shingles(words.hashes(), words.docs, size)
                one, two = sh.digests(x, n)
                items = [np.sort(s).tobytes() for s in np.split(x, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").slice(at, to - at), pa.array(one), pa.array(two), pa.array(items, pa.binary())], ["rep", "fp1", "fp2", "items"]
                )

    return run


def linked_classes(
    docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS, seed: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp1, fp2, ...) of each row of docs (doc_id, text); and the classes of equal sets with links.

    The second table is (c1, c2, component, least): a class's digests, its component, and the smallest doc_id there.
    Two collections of `halves` keys of `rows` minhashes each are computed; a table of the banding is a pair of
    keys, one of each collection, so 2 * halves * rows minhashes serve halves**2 tables of 2 * rows minhashes. A
    key that only one class has can't be part of a shared table and isn't paired. Candidates are confirmed on
    whole sets and joined to components (see linking). A pair of similarity s is a candidate with probability
    (1 - (1 - s**rows)**halves)**2: 0.9996 at 0.8 and over 0.999999 at 0.9.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = scratch.table(slim.mapInArrow(
        _features(size, halves, rows, seed), "doc_id long, n_shingles long, fp1 long, fp2 long, halves array<long>"
    ))
    classes = scratch.table(feats.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves")
    ))
    # A class goes by its smallest doc_id, for the first of a group is mostly what the others were made from; by its digest where it shares that id.
    torn = scratch.table(feats.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("fp1").alias("a"), F.max("fp1").alias("b")
    ).where("a <> b").select(F.col("doc_id").alias("t_id")))
    if torn.isEmpty():
        classes = classes.withColumn("id", F.col("rep"))
    else:
        classes = scratch.table(classes.join(torn, F.col("rep") == F.col("t_id"), "left").withColumn(
            "id", F.when(F.col("t_id").isNull(), F.col("rep")).otherwise(F.col("fp1"))
        ).drop("t_id"))
    half = classes.select("id", "n", F.posexplode("halves").alias("pos", "val"))
    shared = half.groupBy("val").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("val")
    # Written, for groups_of reads the keys twice, and both times would shuffle all halves.
    own = scratch.table(half.join(shared, "val").groupBy("id", "n").agg(F.collect_list(F.struct("pos", "val")).alias("h")))
    left = own.select("id", "n", F.explode(F.filter("h", lambda x: x["pos"] < halves)).alias("l"), "h")
    keyed = left.select(
        "id", "n", "l", F.explode(F.filter("h", lambda x: x["pos"] >= halves)).alias("r")
    ).select("id", "n", F.xxhash64("l.val", "r.val").alias("key"))

    groups = groups_of(keyed, scratch)
    scratch.drop(own)
    wanted = scratch.table(classes.join(members_of(groups), "id", "left_semi").select(
        "id", F.col("rep").alias("w_rep"), F.col("fp1").alias("w1"), F.col("fp2").alias("w2")
    ))
    texts = prefilter.restricted(slim.withColumnRenamed("doc_id", "rep"), "rep", scratch.table(wanted.select("w_rep").distinct()))
    found = texts.mapInArrow(_sets(size), "rep long, fp1 long, fp2 long, items binary")
    same = (F.col("rep") == F.col("w_rep")) & (F.col("fp1") == F.col("w1")) & (F.col("fp2") == F.col("w2"))
    # These three tell a class as its id does, and the join has dealt by them: sets aren't shuffled again to drop repeated rows.
    sets = scratch.table(found.join(wanted, same).dropDuplicates(["rep", "fp1", "fp2"]).select("id", "items"))
    linked = link_components(groups, sets, percent, scratch)
    near = scratch.table(classes.join(linked, "id", "left").select(
        F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), "rep", F.coalesce("component", "id").alias("component")
    ))
    least = near.groupBy("component").agg(F.min("rep").alias("least"))
    scratch.drop(groups, wanted, sets)
    return feats.drop("halves"), scratch.table(near.drop("rep").join(least, "component"))


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    A set holds the distinct size-word shingles of the whole text, words lower-cased in A-Z; with fewer
    words, the whole sequence. Rows with equal sets are one class, whatever their doc_id; classes are linked as
    linked_classes() tells. Null, empty and blank texts have no set: n_shingles 0, linked with nothing, kept.
    Rows of one doc_id are one document: they share the smallest component that one of their texts is in, which
    ties these components together, and all are kept if they have its doc_id. A row whose doc_id is null
    represents no class, and is kept only if its set is empty or no other row has its class. An empty table
    gives an empty result; columns besides doc_id and text are not looked at.
    """
    feats, of = linked_classes(docs, scratch, size, percent, **options)
    out = feats.join(
        of, (F.col("fp1") == F.col("c1")) & (F.col("fp2") == F.col("c2")), "left"
    ).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    own = out.where("n_shingles > 0 and doc_id is not null")
    ties = scratch.table(own.groupBy("doc_id").agg(
        F.min("component_id").alias("a"), F.max("component_id").alias("b")
    ).where("a < b").select(F.col("doc_id").alias("t_id"), "a"))
    if not ties.isEmpty():
        joined = connected_components(own.join(ties, F.col("doc_id") == F.col("t_id")).select("a", F.col("component_id").alias("b")), scratch)
        out = out.join(joined, F.col("component_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "component_id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")
    )


def _marked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, words in sh.chunks(b):
                x, n = sh.shingles(words.hashes(), words.docs, size)
                one, two = sh.digests(x, n)
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(n), pa.array(one), pa.array(two)], ["row", "text", "n", "f1", "f2"]
                )

    return run


def first_of_groups(docs: DataFrame, scratch: Scratch, size: int = 5, **options) -> DataFrame:
    """docs with one row of each group of near duplicates, one of the smallest doc_id; all columns stay.

    Groups are linked_classes()' components. Rows without words and rows without doc_id all stay. Of a doc_id
    with several rows, each is judged by its own text: equal and near ones leave one, others stay. An empty
    table gives an empty result.
    """
    feats, of = linked_classes(docs, scratch, size=size, **options)
    found = scratch.table(feats.where("doc_id is not null and n_shingles > 0").join(
        of, (F.col("fp1") == F.col("c1")) & (F.col("fp2") == F.col("c2"))
    ).select("doc_id", (F.col("doc_id") == F.col("least")).alias("first")))
    by_id = scratch.table(found.groupBy("doc_id").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("c")).where("not first or c > 1"))
    gone, again = (scratch.table(by_id.where(x).select(F.col("doc_id").alias("g_id"))) for x in ("not first", "first"))
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*names, F.lit(0).alias("__none")).alias("row"), "text", F.col("doc_id").cast("long").alias("d_id"))
    rest = prefilter.restricted(rows, "d_id", gone, "left_anti")
    whole = lambda x: x.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    if again.isEmpty():
        return whole(rest)
    marked = prefilter.restricted(rest, "d_id", again).select("row", "text")
    schema = marked.select("row", "text", *(F.lit(0).cast("long").alias(c) for c in ("n", "f1", "f2"))).schema
    marked = scratch.table(marked.mapInArrow(_marked(size), schema))
    one = marked.where("n > 0").join(
        of, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))
    ).where(F.col("row")["doc_id"].cast("long") == F.col("least")).dropDuplicates(["component"])
    others = prefilter.restricted(rest, "d_id", again, "left_anti")
    return whole(others).unionByName(whole(marked.where("n = 0"))).unionByName(whole(one))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the whole documents table, on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op5"), size=2)


#: All pairs by brute force; components by repeated minimum over the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c
  FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 80 * (an + bn - c)),
reach(root, id) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON r.id = l.a AND l.b > r.root),
least_of AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least_of ON s.doc_id = least_of.id
"""
