"""Toxicity scores by weak supervision: many voters, a generative label model, and a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import prefilter
from . import shingles as sh
from .scratch import Scratch

MAX_TOXIC, MAX_CLEAN = 2000, 4000  # texts that the classifier is fitted on, about
BUCKETS = 1 << 18  # of the classifier's hashed features
FOLDS = 4
LEXICON = 2000  # entries of a mined lexicon, at most
LIFT, SURE = 4.0, 6.0  # how much commoner a mined entry is in toxic texts, and the log of that times the root of their number
PREFIXES = (4, 6, 8)  # bytes of a word's beginning that are features, where the word is longer
MANY, MOST = 0.005, 0.015  # shares of a text's words from which a mined lexicon's hits are many, or very many
#: Lexicons that stand by themselves: common insults, by language and kind.
INSULTS = {
    "en_persons": "bastard clown creep dimwit fool idiot imbecile jerk loser moron scum",
    "en_contempt": "brainless disgusting filthy gross hateful pathetic repulsive stupid trash vile worthless",
    "fr": "abruti connard crétin débile idiot idiote imbécile minable ordure salaud stupide",
    "de": "abschaum arschloch blödmann dummkopf ekelhaft erbärmlich idiot trottel vollidiot wertlos widerlich",
    "es": "asqueroso basura cretino estúpido idiota imbécil inútil miserable patético repugnante tonto",
}
PATTERNS = ("shouting", "exclaiming", "masking")

_byte = np.arange(256)
_INNER = (_byte >= 128) | np.isin(_byte, [ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"])
_UPPER, _LETTER = (_byte >= 65) & (_byte <= 90), (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122)
_MASK = np.isin(_byte, [ord(c) for c in "#*$%&@"])


def bare_words(data: np.ndarray, offsets: np.ndarray) -> sh.Words:
    """The words of texts without the punctuation around them, in lower case from A to Z and from À to Þ."""
    low = sh._LOWER[data]
    inner = _INNER[low]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    low[lead] += 0x20
    quote = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80))
    for k in range(3):
        inner[np.minimum(quote + k, len(data) - 1)] = False
    latin = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] <= 0xBF))
    inner[latin] = inner[latin + 1] = False
    return sh.Words(low, offsets, inner)


def _features(words: sh.Words) -> list[np.ndarray]:
    """For each word its own hash, and those of its beginnings, 0 where it isn't longer."""
    return [words.hashes(), *(words.beginnings(k) for k in PREFIXES)]


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, sh.Words]]:
    data, cut = sh.texts_of(b.column("text"))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + sh.CHUNK, "right")) - 1)
        own, ends = data[cut[at] : cut[to]], cut[at : to + 1]
        yield at, to, own, ends - ends[0], bare_words(own, ends)
        at = to


def _of_text(docs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(docs)), np.diff(np.append(0, docs)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean labelled texts of each fold have a feature of each kind."""
    for b in batches:
        for at, to, _, _, words in _chunks(b):
            of, label = _of_text(words.docs), (
                2 * b.column("fold").slice(at, to - at).to_numpy() + b.column("toxic").slice(at, to - at).to_numpy()
            ).astype(np.int64)
            for kind, f in enumerate(_features(words)):
                x, text = sh.distinct(f[f != 0], of[f != 0])
                names, index = np.unique(x, return_inverse=True)
                n = np.bincount(index * 2 * FOLDS + label[text], minlength=len(names) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
                i, j = np.nonzero(n)
                columns = [
                    names[i].view(np.int64), np.full(len(i), kind, np.int32), (j >> 1).astype(np.int32), (j & 1).astype(np.int32),
                    n[i, j].astype(np.int64)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "kind", "fold", "toxic", "n"])


def hand_lexicons() -> list[np.ndarray]:
    """The sorted hashes of each of INSULTS."""
    out = []
    for words in INSULTS.values():
        raw = words.encode()
        out.append(np.sort(bare_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes()))
    return out


def _per_text(flags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.append(0, np.cumsum(flags))[docs]))


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


Lexicons = tuple[list[list[np.ndarray]], list[np.ndarray]]  # mined ones without each fold, and with all, by kind of feature; the others


def votes_of(data: np.ndarray, ends: np.ndarray, words: sh.Words, features: list[np.ndarray], fold: np.ndarray, lexicons: Lexicons) -> np.ndarray:
    """A row of votes for each text: 0 to 3 of a mined lexicon for each kind of feature, 0 or 1 of all others.

    fold tells the fold without which the lexicon of each text is mined; FOLDS stands for the one of all.
    """
    n, of = np.diff(np.append(0, words.docs)), _of_text(words.docs)
    mined, hand = lexicons
    out = []
    for kind, x in enumerate(features):
        hit = np.zeros(len(x), bool)
        for k in np.unique(fold):
            own = np.flatnonzero(fold[of] == k)
            hit[own] = _among(mined[k][kind], x[own])
        hits = _per_text(hit, words.docs)
        out.append((hits > 0).astype(int) + ((hits > 1) & (hits >= MANY * n)) + ((hits > 1) & (hits >= MOST * n)))
    out += [(_per_text(_among(lexicon, features[0]), words.docs) > 0).astype(int) for lexicon in hand]
    upper, letters, cries, masks = (_per_text(f, ends[1:]) for f in (_UPPER[data], _LETTER[data], data == 33, _MASK[data]))
    out += [
        ((n > 4) & (upper > 0.3 * letters)).astype(int), (cries > 0.1 * np.maximum(n, 10)).astype(int), (masks > 0.3 * np.maximum(n, 10)).astype(int)
    ]
    return np.stack(out, axis=1).astype(np.int64)


N_VOTERS = 1 + len(PREFIXES) + len(INSULTS) + len(PATTERNS)


def _codes(votes: np.ndarray) -> np.ndarray:
    """A number for each row of votes."""
    out = np.zeros(len(votes), np.int64)
    for j in range(votes.shape[1]):
        out = out * 4 + votes[:, j]
    return out


def _votes_from(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes >> 2 * (N_VOTERS - 1 - j) & 3 for j in range(N_VOTERS)], axis=1)


def _patterns(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, ends, words in _chunks(b):
                c, n = np.unique(
                    _codes(votes_of(data, ends, words, _features(words), b.column("fold").slice(at, to - at).to_numpy(), shipped.value)),
                    return_counts=True
                )
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], ["code", "n"])

    return run


def label_model(
    votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 200, tie: float = 0.25, most: int = 3
) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Posterior of label 1 for each row of categorical votes, each voter's P(vote > 0 | label), and groups.

    Expectation maximisation of a generative model whose voters are independent given the label; voters whose
    votes correlate given the label (over `tie`) are then put into groups of `most` at most, each with a joint
    vote table, and the model is estimated anew, so that agreeing copies of a voter don't count twice. An
    abstention, 0, is a vote of its own. No label is used; prior is the share of label 1, and rows with more votes
    over 0 are where label 1 is looked for first.
    """
    n, k = votes.shape

    def em(columns: list[np.ndarray], post: np.ndarray) -> tuple[float, np.ndarray]:
        """The likelihood that is reached, and the posteriors."""
        for _ in range(rounds):
            one, none = np.full(n, np.log(prior)), np.full(n, np.log(1 - prior))
            for c in columns:
                size = int(c.max(initial=0)) + 1
                for score, w in ((one, weight * post), (none, weight * (1 - post))):
                    share = np.bincount(c, w, size) + 0.5
                    score += np.log(share / share.sum())[c]
            new = 1 / (1 + np.exp(-np.clip(one - none, -30, 30)))
            done = np.abs(new - post).max(initial=0) < 1e-6
            post = new
            if done:
                break
        return float(weight @ np.logaddexp(one, none)), post

    start = np.clip(0.02 + 1.8 * (votes > 0).mean(axis=1), 0.02, 0.98) if k else np.full(n, prior)
    _, post = em([votes[:, j] for j in range(k)], start)
    on, groups = (votes > 0).astype(float), [[j] for j in range(k)]
    rest = sum(np.sqrt(w)[:, None] * (on - (w[:, None] * on).sum(0) / max(w.sum(), 1e-9)) for w in (weight * post, weight * (1 - post)))
    scale = np.sqrt((rest**2).sum(0)) + 1e-9
    tied = (rest.T @ rest) / np.outer(scale, scale)
    for i, j in sorted(((i, j) for i in range(k) for j in range(i) if tied[i, j] > tie), key=lambda p: -tied[p]):
        a, b = (next(g for g in groups if x in g) for x in (i, j))
        if a is not b and len(a) + len(b) <= most:
            groups.remove(b)
            a += b
    joint = []
    for g in groups:
        c = np.zeros(n, dtype=np.int64)
        for j in g:
            c = c * (int(votes[:, j].max(initial=0)) + 1) + votes[:, j]
        joint.append(c)
    if sum(weight @ (c > 0) > 0.002 * weight.sum() for c in joint) >= 3:  # fewer independent views can't tell the labels apart
        (fit_, first), (other, second) = em(joint, post), em(joint, start)
        post = second if other > fit_ + 0.005 * weight.sum() else first  # where copies had the first estimate to themselves
    rates = np.stack([(w[:, None] * on).sum(0) / max(w.sum(), 1e-9) for w in (weight * post, weight * (1 - post))])
    return post, rates, groups


SHARPNESS = 50  # a share of one in so many words is a feature of value one; a shorter text counts as one of so many
VOTES = 4 * N_VOTERS  # features of the classifier that stand for a voter's vote, after the hashed ones


def _values(words: sh.Words, features: list[np.ndarray], votes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classifier's features of the texts that are asked for, the text of each, and its value.

    These are hashed words and beginnings with SHARPNESS times their share of the text's words, summed by text, and
    a one for each vote over 0.
    """
    n = np.maximum(np.diff(np.append(0, words.docs)), SHARPNESS)
    x, of = np.concatenate(features), np.tile(_of_text(words.docs), len(features))
    on = (x != 0) & texts[of]
    pair, count = np.unique(of[on] * BUCKETS + (x[on] >> sh.U(46)).astype(np.int64), return_counts=True)
    row, voter = np.nonzero((votes > 0) & texts[:, None])
    of = np.append(pair // BUCKETS, row)
    x = np.append(pair % BUCKETS, BUCKETS + 4 * voter + votes[row, voter])
    v = np.append(SHARPNESS * count / n[pair // BUCKETS], np.ones(len(row)))
    order = np.argsort(of, kind="stable")
    return x[order], of[order], v[order]


def _encode(shipped):
    """The sampled texts' vote codes, and their features and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, codes, shares = shipped.value
        for b in batches:
            for at, to, data, ends, words in _chunks(b):
                fold, draw, key = (b.column(c).slice(at, to - at).to_numpy() for c in ("fold", "draw", "key"))
                features = _features(words)
                votes = votes_of(data, ends, words, features, fold, lexicons)
                code = _codes(votes)
                hit = draw < shares[np.minimum(np.searchsorted(codes, code), len(codes) - 1)]
                x, of, v = _values(words, features, votes, hit)
                cut = np.cumsum(np.bincount(of, minlength=len(hit))[hit])[:-1]
                parts = [pa.array(
                    [p.tobytes() for p in np.split(c, cut)][: int(hit.sum())], pa.binary()
                ) for c in (x.astype(np.int32), v.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(code[hit]), *parts], ["key", "code", "x", "v"])

    return run


def _logistic(
    x: np.ndarray, v: np.ndarray, ends: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 12, rate: float = 0.3, ridge: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on soft labels p, and the intercept; AdaGrad over blocks of rows in a fixed shuffle.

    x and v are all rows' features and values, one row after another; ends tells where each ends.
    """
    size, begins = BUCKETS + VOTES, np.append(0, ends[:-1])
    w, pace = np.zeros(size), np.full(size, 1e-8)
    bias, bias_pace = float(np.log((weight @ p + 0.5) / (weight @ (1 - p) + 0.5))), 1e-8
    rng = np.random.Generator(np.random.PCG64(7))
    weight, batch = weight / weight.mean(), min(200, max(8, len(ends) // 40))
    for _ in range(rounds):
        order = rng.permutation(len(ends))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            place = np.concatenate([np.arange(begins[i], ends[i]) for i in own])
            f, value, of = x[place], v[place].astype(float), np.repeat(np.arange(len(own)), (ends - begins)[own])
            z = np.bincount(of, w[f] * value, len(own)) + bias
            err = weight[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p[own]) / len(own)
            on, index = np.unique(f, return_inverse=True)
            step = np.bincount(index, err[of] * value, len(on)) + ridge * w[on]
            pace[on] += step * step
            w[on] -= rate * step / np.sqrt(pace[on])
            bias_pace += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(bias_pace)
    return w, float(bias)


def _folded(docs: DataFrame) -> DataFrame:
    """docs with fold, draw (a number from 0 to 1 by which samples are taken) and key, all from doc_id."""
    id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "*", F.pmod(F.xxhash64(id, F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"),
        (F.pmod(F.xxhash64(id, F.lit(7)), F.lit(1 << 30)) / (1 << 30)).alias("draw"), F.xxhash64(id, F.lit(11)).alias("key")
    )


Model = tuple[np.ndarray, float, Lexicons]


def _nothing(bias: float) -> Model:
    none = np.zeros(0, np.uint64)
    return np.zeros(BUCKETS + VOTES), bias, ([[none] * (1 + len(PREFIXES))] * (FOLDS + 1), [none] * len(INSULTS))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """The classifier's weights and intercept, and the lexicons, from docs (doc_id, text) and labels (doc_id, toxic) of some.

    Voters are the INSULTS, the PATTERNS and a mined lexicon for each kind of feature: words, and beginnings of each
    length. A mined lexicon holds what marks the toxic ones among the labelled texts, counted over all of
    them; here a text meets the one mined without its own fold, so no label speaks on its own text, and in
    score() the one of all folds. All docs given vote; the label model tells from how votes agree how far each is to be trusted, and sees labels only as
    the share of toxic ones. The classifier is fitted on its posteriors, with hashed words and the votes as
    features, on about MAX_TOXIC and MAX_CLEAN texts at most, drawn by a hash of doc_id with weights that restore
    their shares.

    Repeated labels of a document count as toxic if one does; null labels and ids don't count. Without labels of
    both kinds there are no weights, and the score is near 1 or 0.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = scratch.table(labels)
    n = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return _nothing(30.0 if n.get(1) else -30.0)
    sc, texts = docs.sparkSession.sparkContext, _folded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    few = n[0] + n[1] <= prefilter.FEW
    labelled = texts.join(F.broadcast(labels) if few else labels, F.col("doc_id") == F.col("l_id")).select("text", "fold", "toxic")
    by_fold = labelled.mapInArrow(_count, "feature long, kind int, fold int, toxic int, n long").groupBy("feature", "kind")
    counts = by_fold.agg(*(F.sum(F.when(
        (F.col("toxic") == y) & (F.col("fold") == k), F.col("n")
    ).otherwise(0)).alias(f"{'ct'[y]}{k}") for k in range(FOLDS) for y in (0, 1)))
    counts = scratch.table(counts.where(" + ".join(f"t{k}" for k in range(FOLDS)) + " >= 3"))
    told = []
    for k in range(FOLDS + 1):
        t, c = (sum(F.col(f"{y}{j}") for j in range(FOLDS) if j != k) for y in "tc")
        ratio = (t / n[1]) / ((c + 0.5) / n[0])
        told.append(F.when((t > 0) & (ratio >= LIFT), F.struct(F.lit(k).alias("fold"), (F.log(ratio) * F.sqrt(t)).alias("z"))))
    best = counts.select(
        "feature", "kind", F.explode(F.array_compact(F.array(*told))).alias("at")
    ).select("feature", "kind", "at.fold", "at.z").where(F.col("z") >= SURE)
    rank = F.row_number().over(Window.partitionBy("kind", "fold").orderBy(F.desc("z"), "feature"))
    found = best.withColumn("rank", rank).where(F.col("rank") <= LEXICON).select("feature", "kind", "fold").collect()
    of = lambda k, kind: np.sort(np.array([r.feature for r in found if (r.fold, r.kind) == (k, kind)], dtype=np.int64).view(np.uint64))
    mined = [[of(k, kind) for kind in range(1 + len(PREFIXES))] for k in range(FOLDS + 1)]
    lexicons = mined, hand_lexicons()

    found = texts.select("text", "fold").mapInArrow(
        _patterns(sc.broadcast(lexicons)), "code long, n long"
    ).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    scratch.drop(counts)
    if not found:
        return _nothing(float(np.log(n[1] / n[0])))
    codes, weight = np.array([r.code for r in found], dtype=np.int64), np.array([r.n for r in found], dtype=float)
    post, _, _ = label_model(_votes_from(codes), weight, n[1] / (n[0] + n[1]))
    many = [weight[post >= 0.5].sum(), weight[post < 0.5].sum()]
    drawn = np.where(post >= 0.5, min(1.0, MAX_TOXIC / max(many[0], 1)), min(1.0, MAX_CLEAN / max(many[1], 1)))
    rows = texts.select("text", "fold", "draw", "key").where(F.col("draw") <= float(drawn.max())).mapInArrow(
        _encode(sc.broadcast((lexicons, codes, drawn))), "key long, code long, x binary, v binary"
    )
    rows = scratch.table(rows)
    names, x, v = [], [], []  # of the rows as they come; few bytes a feature, for the driver holds them all
    for r in rows.toLocalIterator():
        names.append((r.key, r.code, len(r.x)))
        x.append(np.frombuffer(bytes(r.x), np.int32)), v.append(np.frombuffer(bytes(r.v), np.float32))
    scratch.drop(rows)
    if not names:
        return _nothing(float(np.log(n[1] / n[0])))
    order = sorted(range(len(names)), key=names.__getitem__)
    at, ends = np.searchsorted(codes, [names[i][1] for i in order]), np.cumsum([len(x[i]) for i in order])
    x = np.concatenate([x[i] for i in order])
    v = np.concatenate([v[i] for i in order])
    return *_logistic(x, v, ends, post[at], 1 / drawn[at]), lexicons


def _score_batch(b: pa.RecordBatch, weights: np.ndarray, bias: float, lexicons: Lexicons) -> np.ndarray:
    out = []
    for at, to, data, ends, words in _chunks(b):
        features = _features(words)
        votes = votes_of(data, ends, words, features, np.full(to - at, FOLDS), lexicons)
        n = np.maximum(np.diff(np.append(0, words.docs)), SHARPNESS)
        z = np.full(to - at, bias)
        of = _of_text(words.docs)
        for x in features:
            z += SHARPNESS / n * np.bincount(of, np.where(x != 0, weights[(x >> sh.U(46)).astype(np.int64)], 0), to - at)
        z += np.where(votes > 0, weights[BUCKETS + 4 * np.arange(votes.shape[1]) + votes], 0).sum(axis=1)
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate([np.zeros(0), *out])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): score from 0 to 1 for each row of docs (doc_id, text).

    It depends on the whole text alone. Null, empty and blank texts score as the intercept tells. Repeated rows
    score alike; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), *model[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_score_batch(b, *shipped.value))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def held_out(mod: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 0, F.lit(False))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under the threshold; all columns stay as they are.

    Repeated rows are judged alike; null, empty and blank texts as the intercept tells; rows with a null doc_id
    as all others. An empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), *model[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score_batch(b, *shipped.value) < threshold))

    row = docs.select(F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("__none")).alias("row"), "text")
    kept = row.mapInArrow(run, row.schema)
    return kept.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole documents table, learned from the labels of four fifths of its ids."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.where(~held_out(5)), labels.where(~held_out(5)), Scratch(spark, "op7"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
