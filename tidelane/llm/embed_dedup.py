"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine confirmation, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

COSINE = 0.9
MISS = 1e-4
SKETCH = 256


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table's key and the number of tables for n vectors.

    Keys grow with log2(n), so that chance meetings stay in proportion to n; tables are as many as a pair at
    the threshold needs to share one with probability 1 - miss.
    """
    bits = min(40, max(8, round(math.log2(max(n, 2))) - 2))
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - hit))


def most_unlike(cosine: float) -> int:
    """Differing bits of a sketch that a pair at the threshold exceeds once in a thousand million, at most."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 6 * math.sqrt(SKETCH * p * (1 - p)))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a column of lists that are vectors, by length: their places, and a matrix of them.

    Left out are rows that are null, empty or all zero, or hold a null or a component that isn't finite.
    """
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = np.where(bad, np.nan, flat.to_numpy(zero_copy_only=False).astype(np.float64))
    begin = np.cumsum(n) - n
    for size in np.unique(n[n > 0]):
        at = np.flatnonzero(n == size)
        x = values[begin[at][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield at[good], x[good]


def _hash(bits: int, tables: int, seed: int, block: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                n, col = b.num_rows, b.column("embedding")
                one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
                keys, sketch, told = np.zeros((n, tables), np.int64), np.zeros((n, SKETCH // 64), np.int64), np.zeros(n, bool)
                for at, x in _matrices(col):
                    size = x.shape[1]
                    if size not in planes:
                        planes[size] = np.random.Generator(np.random.PCG64([seed, size])).standard_normal((bits * tables + SKETCH, size))
                    side = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[size].T > 0
                    cut = np.zeros((len(at), tables, 64), dtype=bool)
                    cut[:, :, :bits] = side[:, : bits * tables].reshape(len(at), tables, bits)
                    keys[at] = np.packbits(cut, axis=2, bitorder="little").view(np.int64)[:, :, 0]
                    sketch[at] = np.packbits(side[:, bits * tables :], axis=1, bitorder="little").view(np.int64)
                    d = [xxhash.xxh3_128_digest(v.tobytes()) for v in x]
                    one[at], two[at] = (np.array([int.from_bytes(v[k : k + 8], "little", signed=True) for v in d]) for k in (0, 8))
                    told[at] = True
                lists = lambda x: pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(told * x.shape[1])).astype(np.int32)), pa.array(x[told].ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(one, mask=~told), pa.array(two, mask=~told), lists(keys), lists(sketch), col],
                    ["vec_id", "fp1", "fp2", "keys", "sketch", "x"]
                )

    return run


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the edges as join what all of them join."""
    names, index = np.unique(np.append(u, v), return_inverse=True)
    of, keep = list(range(len(names))), []

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for k, (i, j) in enumerate(zip(index[: len(u)].tolist(), index[len(u) :].tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            of[max(i, j)] = min(i, j)
            keep.append(k)
    return u[keep], v[keep]


_FOUND = "fp1 long, m long, u long, v long"


def _confirm(cosine: float, most: int = 200_000):
    """From pairs with both vectors, how many links each class gets from those that hold, and edges that span them.

    Pairs are gathered before that, `most` at a time, so that a group of near copies gives few rows and not all its pairs.
    """

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        a, b, an, bn, ar, br = (
            np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)
        ) if parts else [np.zeros(0, np.int64)] * 6
        names, index = np.unique(np.append(a, b), return_inverse=True)
        m = np.zeros(len(names), np.int64)
        np.add.at(m, index, np.append(bn, an))
        u, v = _spanning(ar, br)
        null = lambda n: pa.nulls(n, pa.int64())
        columns = [
            pa.concat_arrays([pa.array(names), null(len(u))]), pa.concat_arrays([pa.array(m), null(len(u))]),
            pa.concat_arrays([null(len(m)), pa.array(u)]), pa.concat_arrays([null(len(m)), pa.array(v)])
        ]
        return pa.RecordBatch.from_arrays(columns, ["fp1", "m", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                keep = np.zeros(b.num_rows, dtype=bool)
                other = {int(i): (k, y) for at, y in _matrices(b.column("y")) for k, i in enumerate(at)}
                for at, x in _matrices(b.column("x")):
                    alike = [i for i in range(len(at)) if other[int(at[i])][1].shape[1] == x.shape[1]]
                    if alike:
                        p, q = x[alike], np.stack([other[int(at[i])][1][other[int(at[i])][0]] for i in alike])
                        p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
                        dot = lambda s, t: np.einsum("ij,ij->i", s, t)
                        keep[at[alike]] = dot(p, q) >= cosine * np.sqrt(dot(p, p) * dot(q, q))
                parts.append(tuple(b.column(c).to_numpy()[keep] for c in ("a", "b", "an", "bn", "ar", "br")))
                held += int(keep.sum())
                if held > most:
                    yield flush(parts)
                    parts, held = [], 0
        yield flush(parts)

    return run


def near_duplicate_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, miss: float = MISS, seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Equal vectors are one class, compared once. Classes that agree in a table's signs, and in most of a wider
    sketch, are confirmed by cosine in double precision; each link found counts for every row of both classes, and is
    summed up where it is found.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without vec_id, link
    with nothing. Vectors of other lengths never link. Rows of one vec_id share its component. An empty table
    gives an empty result.
    """
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bits, tables = plan(wide.count(), cosine, miss)
    feats = scratch.table(wide.mapInArrow(
        _hash(bits, tables, seed), "vec_id long, fp1 long, fp2 long, keys array<long>, sketch array<long>, x array<double>"
    ))
    classes = scratch.table(feats.where("fp1 is not null and vec_id is not null").groupBy("fp1", "fp2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
        F.first("x").alias("x")
    ))
    keyed = classes.select(
        F.col("fp1").alias("id"), "rep", "n", *(F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64)),
        F.posexplode("keys").alias("pos", "val")
    ).withColumn("key", F.xxhash64("pos", "val")).drop("pos", "val")
    left = keyed.select("key", *(F.col(c).alias(f"l_{c}") for c in keyed.columns if c != "key"))
    unlike = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"l_s{i}"))) for i in range(SKETCH // 64)), F.lit(0))
    pairs = left.join(keyed, "key").where((F.col("l_id") < F.col("id")) & (unlike <= most_unlike(cosine)))
    pairs = scratch.table(pairs.select(
        F.col("l_id").alias("a"), F.col("id").alias("b"), F.col("l_n").alias("an"), F.col("n").alias("bn"), F.col("l_rep").alias("ar"),
        F.col("rep").alias("br")
    ).distinct())
    x = classes.select("fp1", "x")
    both = pairs.join(x.withColumnRenamed("fp1", "a"), "a").join(x.select(F.col("fp1").alias("b"), F.col("x").alias("y")), "b")
    found = scratch.table(both.select("a", "b", "an", "bn", "ar", "br", "x", "y").mapInArrow(_confirm(cosine), _FOUND))
    scratch.drop(pairs)
    degree = found.where("fp1 is not null").groupBy("fp1").agg(F.sum("m").alias("m"))
    comp = connected_components(found.where("u is not null").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch)
    of = classes.select("fp1", "fp2", "rep", "n").join(degree, "fp1", "left").join(comp, F.col("rep") == F.col("id"), "left")
    of = of.select("fp1", "fp2", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = feats.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("fp1")).alias("fp1"), "fp2").join(of, ["fp1", "fp2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of the whole embeddings table."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op1"))


#: All pairs by brute force.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(root, id) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON r.id = l.a AND l.b > r.root),
least_of AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least_of ON e.vec_id = least_of.id LEFT JOIN degree ON e.vec_id = degree.a
"""
