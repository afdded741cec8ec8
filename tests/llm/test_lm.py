import zlib

import numpy as np
import pytest

from tidelane.llm import maxent_lm as lm

from ..conftest import DATA


def toy(seed=0):
    """Factors over few rows, with weights that aren't nothing."""
    rng = np.random.default_rng(seed)
    of = rng.integers(0, lm.CLASSES - 1, lm.ROWS)
    of[lm.END] = lm.CLASSES - 1
    n = rng.integers(0, 50, lm.ROWS).astype(float)
    factors = lm.Factors(of, n)
    factors.x[: factors.weights] = rng.normal(0, 0.3, factors.weights)
    return factors


def test_probabilities_sum_to_one():
    factors = toy()
    rows = np.append(np.arange(lm.SUFFIXES, lm.SUFFIXES + lm.MEMBERS), lm.END)  # all members but the rare ones
    rare = [int(np.flatnonzero(factors.of[: lm.SUFFIXES] == c)[0]) for c in range(lm.CLASSES - 1)]  # any rare row stands for its class's place
    every = np.append(rows, rare)
    prev = [np.full(len(every), r) for r in (7, lm.START, 4100, 3)]
    logs = factors.logs(factors.x, every, lm.features(prev), lm.inner_features(prev))
    assert np.exp(logs).sum() == pytest.approx(1.0, abs=1e-9)


def test_logs_equal_a_dense_brute_force():
    factors = toy(1)
    w, m, _, _ = factors.tables(factors.x)
    rng = np.random.default_rng(2)
    rows = rng.integers(0, lm.START, 40)
    prev = [rng.integers(0, lm.ROWS, 40) for _ in range(lm.SKIPS)]
    f, g = lm.features(prev), lm.inner_features(prev)
    got = factors.logs(factors.x, rows, f, g)
    for i, r in enumerate(rows):
        c = factors.of[r]
        z = factors.outer + sum(w[k] for k in f[i])
        want = z[c] - np.log(np.exp(z).sum())
        if factors.size[c] > 1:
            y = factors.inner[c] + m[c][g[i, 0]] + m[c][g[i, 1]]
            want += y[factors.member[r]] - np.log(np.exp(y).sum())
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_steps_follow_the_gradient():
    factors = toy(3)
    x = factors.x.copy()
    w, m, _, _ = factors.tables(x)
    rng = np.random.default_rng(4)
    rows = rng.integers(lm.SUFFIXES, lm.SUFFIXES + lm.MEMBERS, 1)
    prev = [rng.integers(0, lm.ROWS, 1) for _ in range(lm.SKIPS)]
    f, g, c = lm.features(prev), lm.inner_features(prev), int(factors.of[rows[0]])
    loss = lambda: -factors.logs(x, rows, f, g)[0]
    grad = np.exp(factors.outer_logs(w, f))[0] - np.eye(lm.CLASSES)[c]
    inner = np.exp(factors.inner_logs(m, c, g))[0] - np.eye(factors.size[c])[factors.member[rows[0]]]
    for table, at, k, want in ((w, f[0, 0], 3, grad[3]), (m[c], g[0, 1], 1, inner[1])):
        e = 1e-5
        table[at, k] += e
        up = loss()
        table[at, k] -= 2 * e
        down = loss()
        table[at, k] += e
        assert (up - down) / (2 * e) == pytest.approx(want, abs=1e-5)


def test_scores_dont_depend_on_partitions_and_beat_the_base(spark, scratch):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    runs = []
    for n in (1, 3, 11):
        got = lm.language_scores(docs.repartition(n).withColumn("key", docs.doc_id).withColumn("rows", docs.doc_id), scratch).collect()
        runs.append({r.doc_id: r.score for r in got})
    for d, s in runs[0].items():
        assert abs(s - runs[1][d]) < 1e-6 * max(1, abs(s)) and abs(s - runs[2][d]) < 1e-6 * max(1, abs(s))
    held = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got} == {True}
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain", gain)
    assert gain > 0.1  # log10 a token


def test_keys_tell_words_and_endings_apart():
    from tidelane.llm import shingles as sh

    raw = b"going, GOING. doing a ... ab, zzing!?"
    words = sh.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    k = lm.keys_of(words)
    assert len(set(k.tolist())) == 7 and len({int(x) & 0xFFF for x in (k[0], k[1], k[2], k[6])}) == 1
    keys, ends = lm.with_ends(words)
    assert keys[-1] == lm.END_KEY and ends.tolist() == [8]


def test_every_frequent_word_has_its_row():
    """Also where two of them would have met in one slot."""
    for seed in range(20):
        keys = np.random.default_rng(seed).integers(1, 1 << 62, lm.FREQUENT)
        assert (lm.Lookup(keys, np.arange(1, len(keys) + 1)).get(keys) == np.arange(1, len(keys) + 1)).all()


def test_scores_of_texts_equal_a_dense_brute_force(spark, scratch, monkeypatch):
    """Each text's score from its tokens, the model's factors and plain counts; and these sum to one over all words."""
    from collections import Counter

    from tidelane.llm import shingles as sh

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()]
    kept = {}
    score = lm._score
    monkeypatch.setattr(lm, "_score", lambda shipped: kept.update(model=shipped.value) or score(shipped))
    got = {r.doc_id: r for r in lm.language_scores(spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()}
    factors, _ = kept["model"]

    def keys(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return lm.with_ends(sh.Words(raw, np.array([0, len(raw)])))[0].tolist()

    count = Counter(k for d, t in docs if zlib.crc32(str(d).encode()) % 10 for k in keys(t))
    order = sorted((k for k in count if k != lm.END_KEY), key=lambda k: (-count[k], k))
    first = np.array(order[: lm.FREQUENT], dtype=np.int64)
    place = lm.Lookup(first, np.arange(1, len(first) + 1)).get(first)  # 0 where two words want one slot
    row = {k: lm.SUFFIXES - 1 + i for k, i in zip(first.tolist(), place.tolist(), strict=True) if i} | {lm.END_KEY: lm.END}
    row_of = lambda k: row.get(k, k & 0xFFF)
    size, distinct = Counter(), Counter()
    for k, c in count.items():
        if lm.RARE[row_of(k)]:
            size[factors.of[row_of(k)]] += c
            distinct[factors.of[row_of(k)]] += 1
    share = lambda k: (count[k] + 0.1) / (size[factors.of[row_of(k)]] + 0.1 * (distinct[factors.of[row_of(k)]] + 1)) if lm.RARE[row_of(k)] else 1.0
    for d, t in docs[:40]:
        tokens = keys(t)
        rows = np.array([row_of(k) for k in tokens])
        prev = lm.before(rows, np.array([0]), np.array([len(rows)]))
        want = (factors.logs(factors.x, rows, lm.features(prev), lm.inner_features(prev)) / np.log(10)).sum() + sum(np.log10(share(k)) for k in tokens)
        assert got[d].score == pytest.approx(want, rel=1e-4, abs=1e-2), d
    every = [*count, *(next(s for s in range(lm.SUFFIXES) if factors.of[s] == c) for c in range(lm.CLASSES - 1))]  # all words, and one unseen of each class
    rows = np.array([row_of(k) for k in count] + every[len(count) :])
    prev = [np.full(len(rows), r) for r in (7, 4100, lm.START, lm.START)]
    p = np.exp(factors.logs(factors.x, rows, lm.features(prev), lm.inner_features(prev)).astype(float))
    unseen = [0.1 / (size[c] + 0.1 * (distinct[c] + 1)) for c in range(lm.CLASSES - 1)]
    assert p @ np.array([share(k) for k in count] + unseen) == pytest.approx(1.0, abs=1e-4)
