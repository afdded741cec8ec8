"""Passages that repeat across documents: MinHash banding of paragraphs, exact Jaccard, components; and equal windows of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prefilter
from . import shingles as sh
from .linking import groups_of, link_components, members_of
from .scratch import Scratch

SIZE = 5
PERCENT = 80
BANDS = 8
ROWS = 3
MIN_WORDS = 20
GRAM = 8
_BLANK = re.compile(rb"[\x20\x09\x0B-\x0D]*")


def paragraphs_of(lines: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the paragraphs begin and end, in words: these are the lines of `least` words or more."""
    begins = np.append(0, lines[:-1])[: len(lines)]
    enough = lines - begins >= least
    return begins[enough], lines[enough]


def anchors(h: np.ndarray, min_words: int) -> np.ndarray:
    """For each window of min_words words, the least hash of the runs of GRAM words inside it.

    Equal windows have the same one, and windows that overlap mostly do, so a text has few.
    """
    k = max(1, min(GRAM, min_words // 2))
    g, want, size = sh.grams(h, k), min_words - k + 1, 1
    while size < want and len(g):
        step = min(size, want - size)
        g, size = np.minimum(g[:-step], g[step:]), size + step
    return g


def sets_in(h: np.ndarray, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each paragraph, one after another, and how many each has; all have SIZE words."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = e - b - SIZE + 1
    of = np.repeat(np.arange(len(b)), c)
    x, of = sh.distinct(sh.grams(h, SIZE)[np.arange(len(of)) + np.repeat(b - np.append(0, np.cumsum(c)[:-1]), c)], of)
    return x, np.bincount(of, minlength=len(b))


def whole_digests(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A digest of each text's sequence of words; 0 for none."""
    n = np.diff(np.append(0, docs))
    place = np.arange(len(h)) - np.repeat(docs - n, n)
    out, has = np.zeros(len(docs), np.uint64), n > 0
    if has.any():
        out[has] = sh.mix(np.add.reduceat(sh.mix(h + sh.mix(place.astype(np.uint64) + sh.U(9))), (docs - n)[has]) + n[has].astype(np.uint64))
    return out.view(np.int64)


def _least_inexact(percent: int) -> int:
    """The fewest shingles at which a set can pass the test with a set that differs from it."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _inside(docs: np.ndarray, n: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n windows lie in one text, and in which each begins."""
    at = np.arange(n)
    doc = np.searchsorted(docs, at, "right")
    return at + min_words <= docs[doc] if n else np.zeros(0, bool), doc


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(values))


def _pieces(bands: int, rows: int, percent: int, seed: int, min_words: int):
    """Rows of paragraphs (n shingles, keys of bands) and of texts (n is less than 0: words; distinct anchors)."""
    least = max(min_words, SIZE)
    long_from = _least_inexact(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sh.constants(seed, bands * rows)
        for batch in batches:
            for at, to, words in sh.chunks(batch):
                ids, h = batch.column("doc_id").slice(at, to - at).to_numpy(zero_copy_only=False), words.hashes()
                b, e = paragraphs_of(words.lines(), least)
                x, n = sets_in(h, b, e)
                fp, _ = sh.digests(x, n)
                long = n >= long_from
                keys = sh.keys(x[np.repeat(long, n)], n[long], c, rows) if long.any() else np.zeros((0, bands), np.int64)
                a = anchors(h, min_words)
                whole, of = _inside(words.docs, len(a), min_words)
                a, of = sh.distinct(a[whole], of[whole])
                total = np.diff(np.append(0, words.docs))
                lists = _lists(np.append(keys.ravel(), a.view(np.int64)), np.append(long * bands, np.bincount(of, minlength=len(ids))))
                held = np.append(ids[np.searchsorted(words.docs, e)], ids)
                sizes = np.append(n, -total).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array(np.append(fp, whole_digests(h, words.docs))), pa.array(sizes), lists], ["doc_id", "fp", "n", "keys"]
                )

    return run


def _among(shipped, *keep: str):
    """Rows of `keep` for each of keys that may be in the bitmap shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys").flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), b.column("keys").value_lengths().to_numpy(zero_copy_only=False))
            may = prefilter.among(shipped.value, keys)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of[may])) for c in keep), pa.array(keys[may])], [*keep, "key"])

    return run


def _windows_and_sets(min_words: int):
    """From texts with their shared anchors and the paragraphs asked for: equal-window hashes, and sorted shingle sets.

    Rows are (doc_id, fp, items); items is null for a window of min_words words.
    """
    least = max(min_words, SIZE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in sh.chunks(batch):
                ids, h = batch.column("doc_id").slice(at, to - at).to_numpy(zero_copy_only=False), words.hashes()
                shared, want = (batch.column(c).slice(at, to - at) for c in ("anchors", "want"))
                a = anchors(h, min_words)
                whole, of = _inside(words.docs, len(a), min_words)
                a, of, x = a[whole], of[whole], sh.grams(h, min_words)[whole]
                known, own = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(
                    np.arange(len(ids)), shared.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                )
                salt = lambda v, k: sh.mix(v + k.astype(np.uint64) * sh.U(0xD6E8FEB86659FD93))  # noqa: E731  a text's own anchors count, not its neighbours'
                hit = np.isin(salt(a, of), salt(known, own))
                x, of = sh.distinct(x[hit], of[hit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(x.view(np.int64)), pa.nulls(len(x), pa.binary())], ["doc_id", "fp", "items"]
                )
                asked = want.flatten().to_numpy(zero_copy_only=False)
                if len(asked):
                    b, e = paragraphs_of(words.lines(), least)
                    x, n = sets_in(h, b, e)
                    fp, first = sh.digests(x, n)[0], np.append(0, np.cumsum(n))
                    take = np.flatnonzero(np.isin(fp, asked))
                    _, new = np.unique(fp[take], return_index=True)
                    take = take[new]
                    of = ids[np.searchsorted(words.docs, e[take])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of), pa.array(fp[take]), pa.array([np.sort(x[first[i] : first[i + 1]]).tobytes() for i in take], pa.binary())],
                        ["doc_id", "fp", "items"]
                    )

    return run


def repeated_pieces(
    docs: DataFrame, scratch: Scratch, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, seed: int = 9, min_words: int = MIN_WORDS
) -> DataFrame:
    """(doc_id, fp, keeper): what docs hold that an earlier document, keeper, has too: texts, paragraphs, windows of words.

    Texts with the same words are one class, of which the smallest doc_id is the keeper. Paragraphs (lines
    of min_words words or more) with the same set of five-word shingles are one class. A set so small that no other set can reach `percent` with it needs no band; larger ones get
    `bands` keys of `rows` minhashes (at 0.8, 99.7 % of pairs share one), and classes that share one are confirmed
    on their whole sets. Each is in two sizes of its key, one of which it shares with all whose size doesn't rule
    out `percent`. keeper is the smallest doc_id of the class's component.

    Windows of min_words words anywhere must be equal. Each has as anchor the least hash of its runs of GRAM
    words; windows are hashed only where their anchor is in two different texts or more, which those of all
    equal windows are, so none is left out. What thins rows by a bitmap is followed by an exact join.
    """
    sc, texts = docs.sparkSession.sparkContext, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    made = scratch.table(texts.mapInArrow(_pieces(bands, rows, percent, seed, min_words), "doc_id long, fp long, n int, keys array<long>"))
    pieces, whole = made.where("n > 0").select("doc_id", "fp", "n", "keys"), made.where(F.col("n") <= -min_words)

    def in_two(keys: DataFrame) -> DataFrame:
        return scratch.table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))

    # Texts: their classes, and one text of each for the anchors.
    firsts = scratch.table(whole.groupBy("fp", "n").agg(
        F.min("doc_id").alias("keeper"), F.max("doc_id").alias("most"), F.first("keys").alias("keys")
    ))
    found = whole.join(
        firsts.where("keeper < most").select("fp", "n", "keeper"), ["fp", "n"]
    ).where("doc_id <> keeper").select("doc_id", "fp", "keeper")
    copies = scratch.table(found.distinct())

    twice = in_two(firsts.select(F.explode("keys").alias("key")))
    thin = firsts.select(F.col("keeper").alias("doc_id"), "keys").mapInArrow(
        _among(sc.broadcast(prefilter.bitmap(twice)), "doc_id"), "doc_id long, key long"
    )
    shared = thin.join(twice, "key").groupBy("doc_id").agg(F.collect_list("key").alias("anchors"))

    # Paragraphs: candidates by bands.
    long = pieces.where("size(keys) > 0")
    banded = in_two(long.groupBy("fp").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("key")))
    keyed = long.select(F.col("fp").alias("id"), F.col("n").cast("long").alias("n"), "keys").mapInArrow(
        _among(sc.broadcast(prefilter.bitmap(banded)), "id", "n"), "id long, n long, key long"
    ).distinct()
    sized = F.floor(F.log("n") / math.log(max(100 / percent, 1.001) * (1 + 1e-9)))
    keyed = keyed.select(
        "id", "n", "key", F.explode(F.array(sized, sized + 1)).alias("size")
    ).select("id", "n", F.xxhash64("key", "size").alias("key"))
    groups = groups_of(keyed, scratch)
    ids = scratch.table(members_of(groups))
    holders = long.select(F.col("fp").alias("id"), "doc_id").join(ids, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    want = holders.groupBy("doc_id").agg(F.collect_list("id").alias("want"))

    # Both need the texts: one pass over those that are asked for.
    asked = scratch.table(shared.join(want, "doc_id", "full").withColumnRenamed("doc_id", "__id"))
    held = scratch.table(texts.join(asked, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "anchors", "want").mapInArrow(
        _windows_and_sets(min_words), "doc_id long, fp long, items binary"
    ))
    windows = held.where("items is null").select("doc_id", "fp")
    again = windows.groupBy("fp").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("most")).where("keeper < most").drop("most")
    equal = windows.join(again, "fp").where("doc_id <> keeper").select("doc_id", "fp", "keeper")

    sets = held.where("items is not null").select(F.col("fp").alias("id"), "items").dropDuplicates(["id"])
    linked = link_components(groups, sets, percent, scratch)
    classes = pieces.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    of = classes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").where("least < most or component is not null")
    of = scratch.table(of.select("fp", F.coalesce("component", "fp").alias("component"), "least", "most"))
    keeper = of.groupBy("component").agg(F.min("least").alias("keeper"), F.max("most").alias("most")).where("keeper < most").drop("most")
    alike = pieces.select("doc_id", "fp").join(of.join(keeper, "component").select("fp", "keeper"), "fp").where("doc_id <> keeper").distinct()
    out = scratch.table(copies.unionByName(alike.select("doc_id", "fp", "keeper")).unionByName(equal))
    scratch.drop(made, firsts, copies, twice, banded, groups, ids, asked, held, of)
    return out


def _at_lines(i: int, j: int, lines: np.ndarray, min_words: int) -> tuple[int, int]:
    """The run from i to j without under SIZE words at its ends that are only part of a further line, if min_words words are left."""
    at = int(np.searchsorted(lines, j))
    begin = int(lines[at - 1]) if at else 0
    if lines[at] != j and j - begin < SIZE and begin - i >= min_words:
        j = begin
    at = int(np.searchsorted(lines, i, "right"))
    end = int(lines[at])
    if i and lines[at - 1] != i and end - i < SIZE and j - end >= min_words:
        i = end
    return i, j


def repeated_runs(h: np.ndarray, lines: np.ndarray, fps: np.ndarray, keepers: np.ndarray, min_words: int) -> tuple[list[tuple[int, int]], set[int]]:
    """The runs of words of one text that fps, digests of what is repeated, cover; and the keepers.

    A run is made of whole paragraphs and of equal windows, and has min_words words or more, half as many
    different ones among them: one word said over and over isn't a passage. The part of a further line that
    equal windows reach into by under SIZE words stays.
    """
    order = np.argsort(fps, kind="stable")
    fps, keepers = fps[order], keepers[order]

    def found(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(fps, x), len(fps) - 1)
        return np.flatnonzero(fps[at] == x), keepers[at]

    held = np.zeros(len(h) + 1, dtype=np.int64)  # at each word, how many marks begin less how many end
    used: list[tuple[int, int, int]] = []
    if len(found(whole_digests(h, np.array([len(h)])))[0]):
        used.append((0, len(h), int(found(whole_digests(h, np.array([len(h)])))[1][0])))
    w = sh.grams(h, min_words).view(np.int64)
    hit, of = found(w) if len(w) else (np.zeros(0, np.int64), w)
    if len(hit):
        cut = np.flatnonzero(np.diff(hit) > min_words)
        for i, j in zip(np.append(0, cut + 1), np.append(cut, len(hit) - 1)):
            begin, end = _at_lines(int(hit[i]), int(hit[j]) + min_words, lines, min_words)
            used += [(begin, end, k) for k in set(of[hit[i : j + 1]].tolist())]
    b, e = paragraphs_of(lines, max(min_words, SIZE))
    if len(b):
        own, of = found(sh.digests(*sets_in(h, b, e))[0])
        used += [(int(b[i]), int(e[i]), int(of[i])) for i in own]
    for i, j, _ in used:
        held[i] += 1
        held[j] -= 1
    on = np.diff(np.concatenate([[0], np.cumsum(held)[:-1] > 0, [0]]).astype(np.int8))
    runs = [
        (int(i), int(j)) for i,
        j in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1)) if j - i >= min_words and 2 * len(np.unique(h[i:j])) >= min_words
    ]
    return runs, {k for i, j, k in used if any(a <= i < z for a, z in runs)}


def _rewrite(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in sh.chunks(batch):
                part, n = batch.slice(at, to - at), np.diff(np.append(0, words.docs))
                fps, keepers = part.column("fps"), part.column("keepers")
                new: dict[int, tuple[str, list[int], int]] = {}
                for k in np.flatnonzero(fps.is_valid().to_numpy(zero_copy_only=False)):
                    text = part.column("text")[int(k)].as_py()
                    if not text or n[k] < min_words:
                        continue
                    raw = text.encode("utf-8", "surrogatepass")
                    own = sh.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    runs, kept_in = repeated_runs(own.hashes(), own.lines(), *(c[int(k)].values.to_numpy() for c in (fps, keepers)), min_words)
                    if runs:
                        out, last = [], 0
                        for i, j in runs:
                            out.append(raw[last : own.starts[i]])
                            last = _BLANK.match(raw, int(own.ends[j - 1])).end()
                        out.append(raw[last:])
                        new[int(k)] = b"".join(out).decode("utf-8", "surrogatepass"), sorted(kept_in), sum(j - i for i, j in runs)
                texts = part.column("text")
                if new:
                    texts = pa.concat_arrays([pa.array([new[k][0]], pa.string()) if k in new else texts.slice(k, 1) for k in range(to - at)])
                of = lambda i, empty: [new[k][i] if k in new else empty for k in range(to - at)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), texts, pa.array(n.astype(np.int64)), pa.array(of(1, []), pa.list_(pa.int64())),
                        pa.array(of(2, 0), pa.int64())
                    ],
                    ["row", "text", "n_words", "kept_in", "removed"]
                )

    return run


def without_repeats(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """(row, text, n_words, kept_in, removed) for each row of docs: row holds its other columns, text what is left.

    The runs of min_words words or more that a document with a smaller doc_id holds too (kept_in lists these) are
    taken out; the first holder keeps them. Null texts stay null, blank ones blank. Rows with a null doc_id
    stay as they are and keep nothing for others. Repeated rows of one doc_id don't count as repeats of each
    other; of documents with the same text the smallest doc_id keeps it, the others are left empty. An empty
    table gives an empty result.
    """
    found = repeated_pieces(docs, scratch, min_words=min_words, **options)
    lists = scratch.table(found.groupBy("doc_id").agg(
        F.collect_list("fp").alias("fps"), F.collect_list("keeper").alias("keepers")
    ).withColumnRenamed("doc_id", "__of"))
    row = F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("__none")).alias("row")
    rows = docs.select(
        row, "text", F.col("doc_id").cast("long").alias("__id")
    ).join(lists, F.col("__id") == F.col("__of"), "left").select("row", "text", "fps", "keepers")
    schema = rows.select(
        "row", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("kept_in"),
        F.lit(0).cast("long").alias("removed")
    ).schema
    return rows.mapInArrow(_rewrite(min_words), schema)


def strip_repeats(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs with repeated passages taken out of text (see without_repeats); all columns and rows stay."""
    out = without_repeats(docs, scratch, **options)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of the whole documents table: what is left of each text, and where the rest is kept."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark, "op9"))
    return out.select(
        "row.doc_id", "n_words", F.col("removed").alias("removed_words"), "kept_in", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
