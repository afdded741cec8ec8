"""Operators and the pipeline's stages against plain versions that look at everything."""

import math
import random
import re
import string
import unicodedata
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from tidelane.llm import minhash, mixing, paragraphs, quality

from ..conftest import DATA, oracle_rows
from .conftest import ODD, SCHEMA
from .test_dedup import brute, reached

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingled(words, size=5):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_passages(docs, least=20):
    """What is left of each text: equal texts, lines of `least` words whose shingles reach 0.8, and windows of `least` equal words."""
    words = {d: WORD.findall(low(t)) for d, t in docs}
    lines = {}
    for d, t in docs:
        at, own = 0, []
        for line in low(t).split("\n"):
            n = len(WORD.findall(line))
            if n:
                own.append((at, at + n))
            at += n
        lines[d] = own
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - least + 1):
            first.setdefault(tuple(words[d][i : i + least]), d)
    units = [(d, i, j, shingled(words[d][i:j])) for d in words for i, j in lines[d] if j - i >= least]
    links = [(a, b) for a in range(len(units)) for b in range(a) if 100 * len(units[a][3] & units[b][3]) >= 80 * len(units[a][3] | units[b][3])]
    of = reached(range(len(units)), links)
    keeper = defaultdict(lambda: math.inf)
    for k, u in enumerate(units):
        keeper[of[k]] = min(keeper[of[k]], u[0])
    out = {}
    for d, t in docs:
        marks = []
        if len(words[d]) >= least and min(e for e in words if words[e] == words[d]) < d:
            marks.append((0, len(words[d])))
        hit = [i for i in range(len(words[d]) - least + 1) if first[tuple(words[d][i : i + least])] < d]
        runs = []
        for i in hit:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = i + least
            else:
                runs.append([i, i + least])
        for i, j in runs:
            begin, end = max(a for a, b in lines[d] if a < j), min(b for a, b in lines[d] if b > i)
            if j not in [b for _, b in lines[d]] and j - begin < 5 and begin - i >= least:
                j = begin
            if i not in [a for a, _ in lines[d]] and end - i < 5 and j - end >= least:
                i = end
            marks.append((i, j))
        marks += [(i, j) for k, (e, i, j, _) in enumerate(units) if e == d and keeper[of[k]] < d]
        gone = [False] * len(words[d])
        for i, j in marks:
            gone[i:j] = [True] * (j - i)
        left, i = [], 0
        while i < len(gone):
            j = i
            while j < len(gone) and gone[j] == gone[i]:
                j += 1
            if not gone[i] or j - i < least or 2 * len(set(words[d][i:j])) < least:
                left += words[d][i:j]
            i = j
        out[d] = left
    return out


def documents_with_passages(seed, n=70):
    rng = random.Random(seed)
    pool = [[f"p{k}x{rng.randrange(10**6)}" for _ in range(rng.choice((12, 22, 40, 60, 90)))] for k in range(14)]
    docs = []
    for d in range(n):
        parts = []
        for k in range(rng.randrange(1, 6)):
            if rng.random() < 0.5:
                parts.append([f"o{d}x{k}x{i}" for i in range(rng.randrange(3, 50))])
            else:
                p = list(rng.choice(pool))
                for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                    p[rng.randrange(len(p))] = f"e{d}x{rng.randrange(99)}"
                parts.append(p[rng.choice((0, 0, 3)) :])
        if rng.random() < 0.2:
            parts.append(["So"] * rng.choice((10, 30)))
        text = "".join(" ".join(p) + rng.choice((" ", "\n", ". \n\n")) for p in parts)
        docs.append((d * 2 + 1, text if d % 9 or d == 0 else docs[rng.randrange(len(docs))][1]))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, scratch, seed):
    docs = documents_with_passages(seed)
    got = {r.row.doc_id: WORD.findall(low(r.text)) for r in paragraphs.without_repeats(
        spark.createDataFrame(docs, "doc_id long, text string"), scratch
    ).collect()}
    want = brute_passages(docs)
    wrong = [d for d, _ in docs if got[d] != want[d]]
    assert len(wrong) <= 0.02 * len(docs), [(d, len(got[d]), len(want[d])) for d in wrong]  # bands find 99.7 % of pairs at 0.8
    assert sum(len(WORD.findall(t)) for _, t in docs) > 1.3 * sum(map(len, got.values()))


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))


def brute_quality(docs):
    classes = lambda t: [
        len(regex.findall(r"\p{Lu}", t)), len(re.findall("[0-9]", t)), len(re.findall(r"[!-/:-@\[-`{-~]", t)), len(re.findall(r"[\x20\x09-\x0D]", t))
    ]
    whole = lambda t: (c := classes(t)) + [len(t) - sum(c)]
    refs = {}
    for lang in {g for _, _, g in docs}:
        texts = [t or "" for _, t, g in docs if g == lang]
        n = Counter(w for t in texts for w in WORD.findall(t.lower()))
        top = sorted(((w, c) for w, c in n.items() if len(w) <= quality.COMMON_LENGTH), key=lambda x: (-x[1], x[0]))[: quality.COMMON]
        refs[lang] = sum(n.values()), [w for w, _ in top], [c for _, c in top] + [sum(n.values()) - sum(c for _, c in top)], [sum(x) for x in zip(*map(whole, texts), strict=True)]
    out = []
    for d, t, lang in docs:
        words, (size, top, counts, shape) = WORD.findall(t or ""), refs[lang]
        own = Counter(w.lower() for w in words)
        far = distance(whole(t or ""), shape) > quality.MAX_CLASS_DISTANCE
        p = [own[w] for w in top]
        far |= len(words) >= quality.MIN_WORDS and distance([*p, len(words) - sum(p)], counts) > quality.MAX_WORD_DISTANCE
        out.append((
            d, round(distance(whole(t or ""), shape), 6), round(distance([*p, len(words) - sum(p)], counts), 6), size >= quality.MIN_REFERENCE and far
        ))
    return out


def test_quality_distances_equal_brute_force(spark, scratch):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    docs += [(1000 + k, *r[1:3]) for k, r in enumerate(ODD)]
    got = quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), scratch).collect()
    want = {d: (c, w, far) for d, c, w, far in brute_quality(docs)}
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.class_distance - want[r.doc_id][0]) < 1e-5 and abs(r.word_distance - want[r.doc_id][1]) < 1e-5, r
        assert r.kept == (not r.base_failed and not want[r.doc_id][2]), r


def test_quality_on_odd_rows(spark, scratch, odd, empty):
    extra = odd.withColumns({c: F.lit("clash") for c in ("t", "words", "lines", "common", "ref_lang", "w", "c", "cl", "top")})
    got = quality.judge(extra, scratch).collect()
    assert len(got) == len(ODD) and len({tuple(r) for r in got if r.doc_id == 6}) == 1
    assert quality.judge(empty, scratch).count() == 0


def test_quality_ranks_words_of_any_length(spark, scratch):
    """A language whose commonest words are long: a text without them is far from it."""
    usual = " ".join(["Donaudampfschiff", "gemeinsamkeiten", *"a b c d e f".split()] * 10)
    docs = [(i, usual, "de") for i in range(60)] + [(60, " ".join(f"w{k % 41}x{k}" for k in range(80)), "de"), (61, usual.replace("gemeinsamkeiten", "q"), "de")]
    df = spark.createDataFrame([(d, t + f" z{d}", g) for d, t, g in docs], "doc_id long, text string, lang string")
    ref = quality.references(df, scratch).first()
    assert {"donaudampfschiff", "gemeinsamkeiten"} <= set(ref.common) and ref.ref_words == sum(len(t.split()) + 1 for _, t, _ in docs)
    got, want = {r.doc_id: r for r in quality.judge(df, scratch).collect()}, brute_quality([tuple(r) for r in df.collect()])
    for d, c, w, _ in want:
        assert abs(got[d].class_distance - c) < 1e-5 and abs(got[d].word_distance - w) < 1e-5


@pytest.mark.parametrize("slots", [1, 1024])
def test_quality_counts_classes_and_common_words_without_listing_them(spark, scratch, monkeypatch, slots):
    monkeypatch.setattr(quality, "SLOTS", slots)
    rng, odd = random.Random(9), list("aZ09ßÿ÷×ÉİΣ日\U0001f600\U0001d400 \t\n\x0b\x85\xa0.,#*$%&|<>-_\u0301")
    docs = [(i, "".join(rng.choice(odd) for _ in range(rng.choice((0, 1, 40, 900)))), rng.choice(("x", "y", None))) for i in range(60)]
    docs += [(100 + i, " ".join(rng.choice(("The", "the", "of", "İn", "w%d" % rng.randrange(300))) for _ in range(200)), "x") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    shaped = quality.with_classes(df.withColumnRenamed("text", "t")).collect()
    for r in shaped:
        named = [sum(unicodedata.category(c) == "Lu" for c in r.t), sum(c in string.digits for c in r.t), sum(c in string.punctuation for c in r.t), sum(c in " \t\n\x0b\f\r" for c in r.t)]
        assert r.cl == [*named, len(r.t) - sum(named)] and r.n_symbols == sum(c in quality.SYMBOLS for c in r.t)
    got = quality.judge(df, scratch)
    want = {d: (c, w) for d, c, w, _ in brute_quality(docs)}
    for r in got.collect():
        assert abs(r.class_distance - want[r.doc_id][0]) < 1e-5 and abs(r.word_distance - want[r.doc_id][1]) < 1e-5, r
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "slots" in plan


def test_pipeline_stages_equal_brute_force(spark, duck, scratch):
    """All stages but the classifier, each on what the one before has left, with odd rows among the documents."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    some = spark.read.parquet(f"{DATA}/documents.parquet").limit(120).select(
        "doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")
    )
    docs = scratch.table(some.where("doc_id > 100").unionByName(spark.createDataFrame(ODD, SCHEMA)).unionByName(spark.createDataFrame(
        [(5000 + d, t, "en", "s", 1) for d, t in documents_with_passages(3, 40)], SCHEMA
    )))
    clean = scratch.table(stages["toxicity"](spark, docs, DATA))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} >= {r[0] for r in ODD}

    near = scratch.table(stages["minhash_dedup"](spark, clean, DATA))
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    once = {d: t for d, t in rows if d is not None}
    kept = {d for d, n, c, k in brute(list(once.items()), 5) if k}
    assert Counter(r.doc_id for r in near.collect()) == Counter([*kept, *(d for d, _ in rows if d is None)])

    left = scratch.table(stages["passage_dedup"](spark, near, DATA))
    want = brute_passages([(r.doc_id, r.text) for r in near.collect() if r.doc_id is not None])
    got = {r.doc_id: WORD.findall(low(r.text)) for r in left.collect()}
    assert left.columns == docs.columns and sum(got[d] != w for d, w in want.items()) <= 1 and got[None] == WORD.findall("no id at all")

    mixed = scratch.table(stages["mix_sources"](spark, left, DATA))
    import duckdb

    c = duckdb.connect()
    c.register("documents", left.toArrow())
    _, taken = oracle_rows(c, mixing.SQL)
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter(r.doc_id for r in mixed.collect() for _ in range(size(r.text))) == Counter({
        d: t for d, _, _, t, _ in ((r[0], r[1], r[2], r[3], r[4]) for r in taken) if t
    })

    coded = stages["bpe"](spark, mixed, DATA).collect()
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded) == Counter((
        r.doc_id, tuple(theirs.encode(r.text or "", add_special_tokens=False).ids)
    ) for r in mixed.collect())


def test_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


def test_first_of_groups_judges_each_row_of_an_id_by_its_text(spark, scratch):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, " ".join(f"v{i}" for i in range(60))), (3, "a b"), (3, "a b"), (3, None), (None, base)]
    got = minhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in got) == [(0, "w0"), (1, "w0"), (2, "v0"), (3, ""), (3, "a ")]
