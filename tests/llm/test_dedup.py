import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import embed_dedup, linking, minhash, paragraphs
from tidelane.llm import shingles as sh
from tidelane.llm.components import connected_components

from .conftest import ODD


def reached(nodes, links):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {n: root(n) for n in nodes}


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def test_components_of_chains_stars_and_loops(spark, scratch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)] + [(
        rng.randrange(300, 400), rng.randrange(300, 400)
    ) for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df, scratch).collect()}
    links = [(a, b) for a, b in edges if a != b]
    assert got == reached({x for e in links for x in e}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def near_copies(seed, n=90):
    rng, words = random.Random(seed), [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice((1, 2, 6, 60, 60, 200)))] for _ in range(12)]
    out = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((i * 3 + 1, " ".join(t)))
    return out


def brute(docs, size):
    own = {d: sets_of(t, size) for d, t in docs}
    links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    of = reached(own, links)
    return {(d, len(own[d]), of[d], of[d] == d) for d in own}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(spark, scratch, size):
    docs = near_copies(size)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), scratch, size=size)
    assert {tuple(r) for r in got.collect()} == brute(docs, size)


def test_last_round_finds_links_that_pivots_miss(spark, scratch, monkeypatch):
    monkeypatch.setattr(linking, "PIVOTS", 1)
    monkeypatch.setattr(linking, "BLOCK", 3)
    docs = near_copies(11)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), scratch, size=2)
    assert {tuple(r) for r in got.collect()} == brute(docs, 2)


def test_minhash_shuffles_halves_and_sets_once(spark, scratch, monkeypatch):
    plans, table = {}, scratch.table

    def noted(df):
        plans.setdefault(tuple(df.columns), df._jdf.queryExecution().executedPlan().toString())
        return table(df)

    monkeypatch.setattr(scratch, "table", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = [*near_copies(7), *near_copies(7)[:30]]  # rows twice, too
        got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), scratch, size=2)
        assert {tuple(r) for r in got.collect()} == brute(docs, 2) and got.count() == len(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "posexplode" not in plans["a", "an", "b", "bn"]  # the keys' pairs come from a table
    assert plans["id", "items"].count("Exchange hashpartitioning") == 2  # the two sides of one join


def test_minhash_on_odd_rows(spark, scratch, odd, empty):
    got = minhash.near_duplicates(odd, scratch, size=2).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[2].n_shingles == 0 and by[2].kept and by[6].component_id == 6 and by[7].component_id == 6 and not by[7].kept
    kept = minhash.first_of_groups(odd, scratch, size=2)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert minhash.near_duplicates(empty, scratch).count() == 0


def words_of(*texts):
    import pyarrow as pa

    return next(sh.chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), most=1 << 30))[2]


def test_words_and_shingle_sets():
    texts = ["a b a b", "a", "", None, "A b\x0bC", "a b c", "x" * 70_000 + " y", "\n\u00e9\u3000\x85 z\n\n\nq"]
    w = words_of(*texts)
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert np.diff(np.append(0, w.docs)).tolist() == n
    count = lambda k: sh.shingles(w.hashes(), w.docs, k)[1].tolist()
    assert count(2) == [2, 1, 0, 0, 2, 2, 1, 2] and count(5) == [1, 1, 0, 0, 1, 1, 1, 1]
    h = w.hashes()
    assert h[0] == h[2] == h[4] == h[5] and len(set(h.tolist())) == 8 and (w.hashes(block=3) == h).all()
    one, two = words_of("\u00c9 a").hashes(), words_of("\u00e9 a").hashes()
    assert one[0] != two[0] and one[1] == two[1]
    assert words_of("a b\nc\n\n\nd e f", "g\n h").lines().tolist() == [2, 3, 6, 7, 8]


def test_words_of_chunks_equal_those_of_the_whole():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "C", "d\n", "\u00e9"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(3)
    parts = list(sh.chunks(b, most=100))
    assert [r for at, to, _ in parts for r in range(at, to)] == list(range(47)) and len(parts) > 10
    assert np.concatenate([w.hashes() for *_, w in parts]).tolist() == words_of(*texts[3:]).hashes().tolist()


def test_vectors_equal_brute_force(spark, scratch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((25, 16))
    x = [(int(i * 2 + 1), (base[i % 25] + rng.choice([0, 0.05, 0.25, 0.5]) * rng.standard_normal(16)).tolist()) for i in range(300)]
    x += [(900, x[0][1]), (901, [v * 3 for v in x[0][1]])]
    odd = [
        (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [])
    ]
    got = {r.vec_id: tuple(r) for r in embed_dedup.near_duplicate_vectors(
        spark.createDataFrame([*x, *odd], "vec_id long, embedding array<double>"), scratch
    ).collect()}
    ids, m = [i for i, _ in x], np.array([v for _, v in x])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.9
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    of, n = reached(ids, links), close.sum(axis=1) - 1
    want = {i: (i, int(k), of[i], of[i] == i) for i, k in zip(ids, n, strict=True)} | {i: (i, 0, i, True) for i, _ in odd}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, [(got[i], want[i]) for i in wrong[:5]]
    assert embed_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


def test_vectors_near_the_threshold_in_64_dimensions(spark, scratch):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        other = rng.standard_normal(64)
        other -= other @ x * x
        other /= np.linalg.norm(other)
        c = rng.uniform(0.88, 0.92)
        rows += [(4 * k, x.tolist()), (4 * k + 1, (7 * (c * x + np.sqrt(1 - c * c) * other)).tolist())]
    copies = rng.standard_normal(64)
    rows += [(5000 + i, (copies + 0.05 * rng.standard_normal(64)).tolist()) for i in range(400)]  # a group of near copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("fp1", F.lit("clash"))
    got = {r.vec_id: tuple(r) for r in embed_dedup.near_duplicate_vectors(df, scratch).collect()}
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    close = m @ m.T >= 0.9
    of = reached(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close), strict=True) if i < j])
    n = close.sum(axis=1) - 1
    wrong = [i for k, i in enumerate(ids) if got[i] != (i, int(n[k]), of[i], of[i] == i)]
    assert not wrong and 200 < n[:600].sum() < 400 and n[600:].min() > 300, wrong[:5]


def test_repeated_and_null_vector_ids(spark, scratch):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, w), (2, v), (3, w), (None, v), (4, [1.0, 0.0])]
    got = embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert {r.vec_id: r.component_id for r in got if r.vec_id} == {1: 1, 2: 1, 3: 1, 4: 4}


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(f"p{rng.randrange(10**6)}" + ("." if i % 9 == 8 else "") for i in range(n))


def host(seed, n=120):
    rng = random.Random(seed)
    return [f"h{rng.randrange(10**6)}" + ("." if rng.random() < 0.1 else "") for _ in range(n)]


def test_planted_passages_go_and_clean_documents_stay(spark, scratch):
    docs, spans = [], {}
    for d in range(60):
        w = host(d)
        if d % 3 == 0:
            p, at = passage(d % 2, 56), random.Random(d).randrange(100)
            w[at:at] = p.split()
            spans[d] = p
        docs.append((d, " ".join(w)))
    out = {r.row.doc_id: r for r in paragraphs.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()}
    first = {p: min(d for d in spans if spans[d] == p) for p in set(spans.values())}
    for d, t in docs:
        if d not in spans or first[spans[d]] == d:
            assert out[d].text == t and out[d].removed == 0
        else:
            assert 56 <= out[d].removed <= 57 and first[spans[d]] in out[d].kept_in
            own = lambda x: [w for w in x.split() if w[0] == "h"]
            assert len(own(t)) - len(own(out[d].text)) <= 2  # a nearly equal piece may begin or end with a word of its text


def test_nearly_equal_paragraphs_are_found(spark, scratch):
    a = [f"w{i}" for i in range(60)]
    b = a[:30] + ["changed"] + a[31:]
    docs = spark.createDataFrame([(1, " ".join(a) + "\nown one"), (2, " ".join(b) + "\nown two")], "doc_id long, text string")
    out = {r.row.doc_id: r for r in paragraphs.without_repeats(docs, scratch).collect()}
    assert out[1].removed == 0 and out[2].removed >= 20 and out[2].text.endswith("own two")


def test_passages_on_odd_rows(spark, scratch, odd, empty):
    got = paragraphs.strip_repeats(odd, scratch)
    assert got.columns == odd.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, odd.collect()))
    assert paragraphs.strip_repeats(empty, scratch).count() == 0


def stripped(spark, scratch, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id: r for r in paragraphs.without_repeats(rows, scratch).collect()}


def test_unpunctuated_passages_inside_a_line_go_whole(spark, scratch):
    texts, own = [], []
    for k in range(12):
        p = [f"p{k}x{i}" for i in range((51, 20, 60)[k % 3])]
        for d in range(2):
            a, b = ([f"o{k}x{d}x{side}x{i}" for i in range(40)] for side in range(2))
            texts.append(" ".join(a + p + b)), own.append(" ".join(a + b))
    out = stripped(spark, scratch, *texts)
    for d in range(24):
        assert out[d].text == (own[d] if d % 2 else texts[d])


def test_passages_of_short_lines_go_whole(spark, scratch):
    lines = "\n".join(" ".join(f"s{i}x{j}" for j in range(1 + i % 4)) for i in range(22))
    shout = " ".join(f"WORD{i}!!" for i in range(55))
    near = lambda x: " ".join([*(f"n{i}" for i in range(30)), x, *(f"n{i}" for i in range(30, 60))]) + ". Yes!"
    one, two = ("\n".join([
        f"first own {d}", lines, f"then own {d}", shout, f"more own {d}", near("changed" if d else ""), f"last own {d}"
    ]) for d in range(2))
    out = stripped(spark, scratch, one, two)
    assert out[0].text == one
    assert out[1].text.split() == "first own 1 then own 1 more own 1 last own 1".split()


def test_unique_short_lines_between_shared_sentences_stay(spark, scratch):
    ends = [" ".join(f"e{k}x{i}" for i in range(14)) + "." for k in range(2)]
    body = ["\n".join(f"d{d}l{i}a d{d}l{i}b d{d}l{i}c d{d}l{i}d" for i in range(200)) for d in range(2)]
    texts = [f"{ends[0]}\n{body[d]}\n{ends[1]}" for d in range(2)]
    out = stripped(spark, scratch, *texts)
    assert [out[d].text for d in range(2)] == texts and out[1].removed == 0


def test_whole_paragraphs_with_a_changed_word_go_whole(spark, scratch):
    rng, texts = random.Random(4), []
    for k in range(20):
        a = [f"c{k}x{i}" for i in range(51 + 9 * (k % 2))]
        at = rng.randrange(22, 29)
        for d in range(2):
            b = a[:at] + ["changed"] * d + a[at + d :]
            b[9] += "."  # sentences of the paragraph are units, too
            texts.append(f"own{k}x{d}\n" + " ".join(b) + f"\nend{k}x{d}")
    out = stripped(spark, scratch, *texts)
    for d in range(1, 40, 2):
        assert out[d].text.split() == [f"own{d // 2}x1", f"end{d // 2}x1"]


def test_tables_give_the_drivers_heap_back(spark, scratch, monkeypatch):
    """What jobs leave behind doesn't stay with the driver's JVM once a table is written."""
    monkeypatch.setattr("tidelane.llm.scratch.HEAP_SHARE", 0.0, raising=False)
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    gone = spark.range(2_000_000).select(F.col("id").cast("string")).collect()
    del gone
    before = runtime.totalMemory()
    scratch.table(spark.range(5))
    used = runtime.totalMemory() - runtime.freeMemory()
    assert runtime.totalMemory() < before and runtime.totalMemory() < 3 * used
