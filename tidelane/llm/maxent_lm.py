"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as sh
from .frequent import commonest
from .scratch import Scratch

SUFFIXES = 4096  # rows of words that aren't frequent, by a hash of their last letters
FREQUENT = 1024  # words with a row of their own
MEMBERS = 128  # of these, the commonest, that have a place of their own within their class
ANCHORS = 64  # commonest words; what follows them tells the classes of rows
TABLE = 1 << 18  # words whose counts are sent to the tasks
CLASSES = 16  # the last one is the end's alone
END, START, ROWS = SUFFIXES + FREQUENT, SUFFIXES + FREQUENT + 1, SUFFIXES + FREQUENT + 2
SKIPS = 4  # single words before the predicted one that are features of its class, besides the last two together
HASHED = 1 << 14  # features of classes
INNER = 1 << 10  # features of the words within a class: the last word, and the one before it
SHARD = 8000  # training texts of a shard, about: these take gradient steps one after another
BATCH = 16384
END_KEY = -1
_BLOCKS = 16
FAN = 32  # shards' arrays that are added up at once, about
RARE = np.isin(np.arange(ROWS), [*range(SUFFIXES), *range(SUFFIXES + MEMBERS, SUFFIXES + FREQUENT)])  # rows without a place of their own
_PUNCTUATION = np.isin(np.arange(256), [ord(c) for c in ".,;:!?|"])


def keys_of(words: sh.Words) -> np.ndarray:
    """A key for each word: 52 bits of its hash, and below them its row among the suffixes."""
    ends = words.ends.copy()
    for _ in range(3):
        ends -= _PUNCTUATION[words.data[ends - 1]] & (ends - words.starts > 1)
    tail = np.zeros(len(words), dtype=np.uint64)
    for k in range(1, 4):
        at = ends - k
        tail = tail * sh.U(256) + np.where(at >= words.starts, sh._LOWER[words.data[np.maximum(at, 0)]], 0).astype(np.uint64)
    return (words.hashes() & ~sh.U(0xFFF) | sh.mix(tail) % sh.U(SUFFIXES)).view(np.int64)


def with_ends(words: sh.Words) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the texts' words, each text followed by END_KEY, and where the texts end."""
    ends = words.docs + np.arange(1, len(words.docs) + 1)
    out = np.full(len(words) + len(words.docs), END_KEY, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends - 1] = False
    out[inside] = keys_of(words)
    return out, ends


def trained_on() -> Column:
    """Whether a document is learned from, by crc32 of its doc_id; a null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["key", "c"])

    parts, size = [], 0
    for b in batches:
        for _, _, words in sh.chunks(b):
            parts.append(with_ends(words)[0])
            size += len(parts[-1])
            if size > 1_000_000:
                yield flush(parts)
                parts, size = [], 0
    yield flush(parts)


class Lookup:
    """Counts of common keys in one table of slots; of more than FREQUENT keys, one that found its slot taken isn't in it.

    FREQUENT keys or fewer are all in it: multipliers are tried until each key has a slot of its own.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int = 20):
        self.bits, self.key, self.value = bits, np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for k in range(1000 if len(keys) <= FREQUENT else 1):
            self.by = np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
            at = self.slot(keys)
            _, first = np.unique(at, return_index=True)  # keys come by falling count
            if len(first) == len(keys):
                break
        self.key[at[first]], self.value[at[first]] = keys[first], counts[first]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.by) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; 0 where the table has no entry."""
        at = self.slot(keys)
        return np.where(self.key[at] == keys, self.value[at], 0)


def _encode(shipped):
    """Rows of each text's tokens, sums of log10(c + 0.1) over its common words and over its frequent ones, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, frequent = (Lookup(*x) for x in shipped.value)
        for b in batches:
            for at, to, words in sh.chunks(b):
                part = b.slice(at, to - at)
                k, ends = with_ends(words)
                cut = np.append(0, ends).astype(np.int32)
                own = frequent.get(k)
                rows = np.where(k == END_KEY, END, np.where(own > 0, SUFFIXES - 1 + own, k & 0xFFF)).astype(np.int16)
                c = counts.get(k)
                log = np.where(c > 0, np.log10(c + 0.1), 0.0)
                logs, known = np.add.reduceat(log, cut[:-1]), np.add.reduceat(np.where((own > 0) & (own <= MEMBERS) | (k == END_KEY), log, 0.0), cut[:-1])
                found = np.add.reduceat((c > 0).astype(np.int64), cut[:-1])
                of = np.flatnonzero(c == 0)
                rare = np.searchsorted(of, cut).astype(np.int32)
                arrays = [
                    part.column("doc_id"), part.column("train"), pa.ListArray.from_arrays(pa.array(cut), pa.array(rows)), pa.array(logs),
                    pa.array(known), pa.array(found), pa.ListArray.from_arrays(pa.array(rare), pa.array(k[of]))
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "train", "rows", "logs", "known", "found", "rare"])

    return run


def summed(parts: DataFrame, scratch: Scratch) -> dict[int, np.ndarray]:
    """Sums of the float32 arrays in parts (block, part, data), by block; gathered by FAN of them, in order of part, over and over."""

    def add(key, rows):
        import pandas as pd

        total = np.zeros(0)
        for d in rows.sort_values("part")["data"]:
            x = np.frombuffer(d, dtype=np.float32)
            total = x.astype(float) if not len(total) else total + x
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "data": [total.astype(np.float32).tobytes()]})

    parts = scratch.table(parts)
    n = parts.count() // _BLOCKS
    while True:
        groups = max(1, -(-n // FAN))
        parts = parts.withColumn("part", F.pmod(F.col("part"), F.lit(groups)))
        parts = scratch.table(parts.groupBy("block", "part").applyInPandas(add, "block int, part long, data binary"))
        if groups == 1:
            break
        n = groups
    return {r.block: np.frombuffer(bytes(r.data), dtype=np.float32) for r in parts.select("block", "data").collect()}


def _blocks(x: np.ndarray, part: int) -> list[pa.Array]:
    cut = np.array_split(np.ascontiguousarray(x, dtype=np.float32).ravel(), _BLOCKS)
    return [pa.array(range(_BLOCKS), pa.int32()), pa.array([part] * _BLOCKS, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())]


_PARTS = "block int, part long, data binary"


def _whole(found: dict[int, np.ndarray], size: int) -> np.ndarray:
    return np.concatenate([found[i] for i in range(_BLOCKS)]).astype(float) if found else np.zeros(size)


def before(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For k from 1 to SKIPS, the row of the token k places before each, START where the text has none."""
    at = np.arange(len(rows)) - np.repeat(starts, ends - starts)
    out = []
    for k in range(1, SKIPS + 1):
        x = np.full(len(rows), START, dtype=np.int64)
        x[k:] = np.where(at[k:] >= k, rows[:-k], START)
        out.append(x)
    return out


def _scrambled(x: np.ndarray, bits: int) -> np.ndarray:
    x = x & 0xFFFFFFFF
    x ^= x >> 15
    return (x * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - bits)


def features(prev: list[np.ndarray]) -> np.ndarray:
    """Hashed features of each context for its class: the single words before, by distance, and the last two together."""
    mixed = [(p + 1) * (0x9E3779B1 + 2 * 0x85EBCA6B * k) for k, p in enumerate(prev)]
    mixed.append((prev[0] + 1) * 0xC2B2AE35 + (prev[1] + 1) * 0x27D4EB2F + 0x165667B1)
    return _scrambled(np.stack(mixed, axis=1), HASHED.bit_length() - 1)


def inner_features(prev: list[np.ndarray]) -> np.ndarray:
    """Hashed features of each context for the word within its class: the last word, and the one before it."""
    return _scrambled(np.stack([(prev[0] + 1) * 0x85EBCA6B, (prev[1] + 1) * 0xC2B2AE35 + 0x165667B1], axis=1), INNER.bit_length() - 1)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few texts, for what is made of a text's tokens is many times its size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = b.column("rows")
    cut = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[cut[0] : cut[-1]].astype(np.int64), cut[:-1] - cut[0], cut[1:] - cut[0]


def _follow(anchor: np.ndarray):
    """How often each row follows each anchor, as (row, anchor, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * ANCHORS, dtype=np.int64)
        for b in _parts(batches):
            rows, starts, ends = _texts(b)
            a = anchor[before(rows, starts, ends)[0]] if len(rows) else np.zeros(0, np.int64)
            total += np.bincount((rows * ANCHORS + a)[a >= 0], minlength=ROWS * ANCHORS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    return run


def induce_classes(follows: np.ndarray, seed: int = 8, rounds: int = 40) -> np.ndarray:
    """A class for each row: hard clusters of a mixture of multinomials over the anchors before it."""
    rng, k = np.random.Generator(np.random.PCG64(seed)), CLASSES - 1
    n = follows.sum(axis=1)
    share = (follows + 0.5 * follows.sum(axis=0) / max(follows.sum(), 1)) / (n[:, None] + 0.5)
    centre = [int(np.argmax(n))]
    root = np.sqrt(share)
    far = np.full(len(n), np.inf)
    for _ in range(k - 1):  # heavy rows far from those chosen
        far = np.minimum(far, ((root - root[centre[-1]]) ** 2).sum(axis=1))
        centre.append(int(np.argmax(far * np.sqrt(n + 1e-9) * (0.9 + 0.2 * rng.random(len(n))))))
    p = np.log(share[centre] + 1e-9)
    for _ in range(rounds):
        of = np.argmax((follows @ p.T) + 1e-9 * rng.random((len(n), k)), axis=1)
        sums = np.stack([follows[of == c].sum(axis=0) for c in range(k)]) + 0.5 * follows.sum(axis=0) / max(follows.sum(), 1) + 1e-9
        p = np.log(sums / sums.sum(axis=1, keepdims=True))
    of[END] = CLASSES - 1
    return of


class Factors:
    """The model's two softmaxes: over classes, and in each class over its commonest words and one member for all its others.

    of is each row's class, n the training tokens of each row. Weights begin at nothing, so a model without steps
    gives each class and member its share; weights and AdaGrad's paces lie in one vector, so that changes can be
    added up.
    """

    def __init__(self, of: np.ndarray, n: np.ndarray):
        self.of, own = of, np.arange(SUFFIXES, SUFFIXES + MEMBERS)
        self.member, self.size = np.zeros(ROWS, dtype=np.int64), np.ones(CLASSES, dtype=np.int64)
        self.inner: list[np.ndarray] = []  # log shares of a class's members; the first one stands for all its rare words
        for c in range(CLASSES):
            rows = own[of[own] == c] if c < CLASSES - 1 else np.zeros(0, np.int64)
            self.member[rows] = np.arange(1, len(rows) + 1)
            self.size[c] = len(rows) + 1
            share = np.append(n[RARE & (of == c)].sum(), n[rows]) + 0.1
            self.inner.append(np.log(share / share.sum()))
        total = np.bincount(of, n, CLASSES) + 0.1
        self.outer = np.log(total / total.sum())
        cut = np.cumsum([HASHED * CLASSES, *(INNER * self.size), HASHED, CLASSES * INNER])
        self.cut, self.weights, self.length = cut, int(cut[CLASSES]), int(cut[-1])
        self.x = np.zeros(self.length)
        self.x[self.weights :] = 1.0

    def small(self) -> Factors:
        """The same in single precision, for the work on all tokens."""
        out = copy.copy(self)
        out.x, out.outer, out.inner = self.x.astype(np.float32), self.outer.astype(np.float32), [v.astype(np.float32) for v in self.inner]
        return out

    def tables(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Views of a vector: class weights, member weights by class, and what each feature of either has."""
        w, *m, a, b = np.split(x, self.cut[:-1])
        return w.reshape(HASHED, CLASSES), [v.reshape(INNER, -1) for v in m], a, b.reshape(CLASSES, INNER)

    def outer_logs(self, w: np.ndarray, f: np.ndarray) -> np.ndarray:
        z = self.outer + w[f[:, 0]]
        for j in range(1, f.shape[1]):
            z += w[f[:, j]]
        return _log_softmax(z)

    def inner_logs(self, m: list[np.ndarray], c: int, g: np.ndarray) -> np.ndarray:
        return _log_softmax(self.inner[c] + m[c][g[:, 0]] + m[c][g[:, 1]])

    def logs(self, x: np.ndarray, rows: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The natural logarithm of each token's class and member, given its context's features."""
        w, m, _, _ = self.tables(x)
        c, k = self.of[rows], self.member[rows]
        out = self.outer_logs(w, f)[np.arange(len(rows)), c]
        for y in np.unique(c):
            if self.size[y] > 1:
                at = np.flatnonzero(c == y)
                out[at] += self.inner_logs(m, y, g[at])[np.arange(len(at)), k[at]]
        return out


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _descend(weights: np.ndarray, pace: np.ndarray, seen: np.ndarray, f: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One AdaGrad step with the gradient g of each row's logits on the weights of its features."""
    for j in range(f.shape[1]):
        order = np.argsort(f[:, j], kind="stable")
        at = f[order, j]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows, total = at[first], np.add.reduceat(g[order], first, axis=0)
        seen[rows] += np.diff(np.append(first, len(at)))
        pace[rows] += (total * total).sum(axis=1)
        weights[rows] -= rate * total / np.sqrt(pace[rows])[:, None]


def _train(shipped, rate: float):
    """AdaGrad steps over one shard's texts, in an order of their own; gives its change of the vector, by features seen."""

    def run(table: pa.Table) -> pa.Table:
        factors, shard = shipped.value, table.column("shard")[0].as_py()
        x, seen = factors.x.copy(), np.zeros(factors.length, dtype=np.float32)
        (w, m, pace, inner_pace), (_, _, seen_w, seen_m) = factors.tables(x), factors.tables(seen)
        table = table.sort_by([("place", "ascending"), ("doc_id", "ascending")]).select(["rows"]).combine_chunks()
        for b in _parts(table.to_batches()):
            rows, starts, ends = _texts(b)
            if not len(rows):
                continue
            prev = before(rows, starts, ends)
            f, g, c, k = features(prev), inner_features(prev), factors.of[rows], factors.member[rows]
            for at in range(0, len(rows), BATCH):
                own = slice(at, at + BATCH)
                grad = np.exp(factors.outer_logs(w, f[own]))
                grad[np.arange(len(grad)), c[own]] -= 1
                _descend(w, pace, seen_w, f[own], grad, rate)
                for y in np.unique(c[own]):
                    if factors.size[y] > 1:
                        here = at + np.flatnonzero(c[own] == y)
                        grad = np.exp(factors.inner_logs(m, y, g[here]))
                        grad[np.arange(len(here)), k[here]] -= 1
                        _descend(m[y], inner_pace[y], seen_m[y], g[here], grad, rate)
        change = factors.tables(x - factors.x)
        change[0][:] *= seen_w[:, None]
        for y in range(CLASSES):
            change[1][y][:] *= seen_m[y][:, None]
        change[2][:] *= seen_w
        change[3][:] *= seen_m
        whole = np.concatenate([change[0].ravel(), *(v.ravel() for v in change[1]), change[2], change[3].ravel(), seen_w, seen_m.ravel()])
        return pa.table(_blocks(whole, shard), names=["block", "part", "data"])

    return run


def _merged(factors: Factors, got: np.ndarray) -> np.ndarray:
    """The vector after shards' changes, each feature's averaged over the shards by how often they saw it."""
    seen = np.maximum(got[factors.length :], 1)
    full = np.ones(factors.length)
    w, m, a, b = factors.tables(full)
    seen_w, seen_m = seen[:HASHED], seen[HASHED:].reshape(CLASSES, INNER)
    w[:], a[:], b[:] = seen_w[:, None], seen_w, seen_m
    for y in range(CLASSES):
        m[y][:] = seen_m[y][:, None]
    return factors.x + got[: factors.length] / full


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, rest = shipped.value
        for b in _parts(batches):
            rows, starts, ends = _texts(b)
            got = [np.zeros(0)]
            prev = before(rows, starts, ends) if len(rows) else []
            f, g = (features(prev), inner_features(prev)) if len(rows) else (None, None)
            for at in range(0, len(rows), BATCH):
                own = slice(at, at + BATCH)
                got.append(factors.logs(factors.x, rows[own], f[own], g[own]) / np.log(10) - np.where(
                    RARE[rows[own]], rest[factors.of[rows[own]]], 0
                ))
            total = np.append(0.0, np.cumsum(np.concatenate(got)))
            keep = [n for n in b.schema.names if n != "rows"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in keep), pa.array(total[ends] - total[starts]), pa.array(ends - starts)], [*keep, "context", "n_tokens"]
            )

    return run


def language_scores(docs: DataFrame, scratch: Scratch, rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    The model gives a token's class given hashed features of the words before it, then the word within its class
    given features of the last two words; a class's words beyond the MEMBERS commonest of all share one place there,
    by smoothed counts: P(class | context) * P(member | class, context), and for these * (c + 0.1) / (N + 0.1 * (V + 1)),
    N and V being tokens and distinct words of that kind in the class. Classes come from the words that tokens
    follow. All training documents count in every statistic, and all give gradient steps: each round takes its
    share of them, in shards of about SHARD texts that take steps from the same weights, and the shards' changes
    are averaged by feature. A token's count comes from a table of the TABLE commonest or, for all others, from a
    join. Rounds, shards and the order in them follow from hashes of doc_id and text, so scores don't depend on
    how rows are dealt.

    Null and empty texts are one end token. Repeated rows count and score each; rows with a null doc_id are learned
    from. An empty table gives an empty result; without training documents all classes are alike.
    """
    sc = docs.sparkSession.sparkContext
    t = docs.select("doc_id", "text", trained_on().alias("train"))
    counts = t.where("train").select("text").mapInArrow(_count_keys, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    counts = scratch.table(counts)
    by_suffix = {r.s: (r.n, r.v) for r in counts.where(F.col("key") != END_KEY).groupBy(F.col("key").bitwiseAND(F.lit(0xFFF)).alias("s")).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")
    ).collect()}
    top = commonest(counts.where(F.col("key") != END_KEY), "c", TABLE).toPandas().sort_values(["c", "key"], ascending=[False, True])
    keys, c = top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    ends = counts.where(F.col("key") == END_KEY).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    own = sc.broadcast((
        (np.append(END_KEY, keys) if ends else keys, np.append(ends, c) if ends else c), (keys[:FREQUENT], np.arange(1, len(keys[:FREQUENT]) + 1))
    ))
    doc_type = dict(docs.dtypes)["doc_id"]
    coded = t.mapInArrow(
        _encode(own), f"doc_id {doc_type}, train boolean, rows array<smallint>, logs double, known double, found long, rare array<long>"
    )
    coded = scratch.table(coded.withColumn("rid", F.monotonically_increasing_id()))  # for the join with rare words alone

    n, v = np.zeros(ROWS), np.zeros(ROWS)
    for s, (a, b) in by_suffix.items():
        n[s], v[s] = a, b
    lookup = Lookup(keys[:FREQUENT], np.arange(1, len(keys[:FREQUENT]) + 1))
    row = SUFFIXES - 1 + lookup.get(keys[:FREQUENT])
    for k, r, a in zip(keys[:FREQUENT], row, c[:FREQUENT], strict=True):
        if r >= SUFFIXES:  # the words with their own row leave that of their suffix
            n[r], v[r] = a, 1
            n[k & 0xFFF] -= a
            v[k & 0xFFF] -= 1
    n[END], v[END] = ends, ends > 0
    tokens, distinct = int(n.sum()), int(v.sum())

    anchor = np.full(ROWS, -1, dtype=np.int64)
    anchor[row[:ANCHORS]] = np.arange(len(row[:ANCHORS]))
    place = F.xxhash64(F.col("doc_id").cast("string"), "rows")
    learn = coded.where("train").select("rows", F.col("doc_id").cast("string").alias("doc_id"), place.alias("place"))
    cells = learn.select("rows").mapInArrow(_follow(anchor), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    follows = np.zeros(ROWS * ANCHORS)
    follows[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    factors = Factors(induce_classes(follows.reshape(ROWS, ANCHORS)), n)
    shards = max(1, round(learn.count() / rounds / SHARD))
    for r in range(rounds):
        share = learn.where(F.pmod(F.xxhash64("place", F.lit(1)), F.lit(rounds)) == r).withColumn(
            "shard", F.pmod(F.xxhash64("place", F.lit(2)), F.lit(shards))
        )
        got = _whole(
            summed(share.groupBy("shard").applyInArrow(_train(sc.broadcast(factors.small()), rate), _PARTS), scratch),
            factors.length + HASHED + CLASSES * INNER
        )
        factors.x = _merged(factors, got)
    of = factors.of[RARE]
    rest = np.log10(np.bincount(of, n[RARE], CLASSES) + 0.1 * (np.bincount(of, v[RARE], CLASSES) + 1))
    scored = coded.mapInArrow(
        _score(sc.broadcast((factors.small(), rest))),
        f"doc_id {doc_type}, train boolean, logs double, known double, found long, rare array<long>, rid long, context double, n_tokens long"
    )
    scored = scratch.table(scored)

    rare = coded.where("size(rare) > 0").select("rid", F.explode("rare").alias("key"))
    met = rare.join(counts, "key", "left").groupBy("rid").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("r_logs"), F.count("c").alias("r_known")
    )
    x = scored.drop("rare").join(met, "rid", "left")
    logs = F.col("logs") + F.coalesce("r_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * float(np.log10(tokens + 0.1 * (distinct + 1)))
    return x.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("found") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (logs - F.col("known") + F.col("context")).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table, learned from nine tenths of its ids."""
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op8"))
