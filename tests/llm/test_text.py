import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.llm import maxent_lm, mixing, quality, toxicity, urls, warc
from tidelane.llm.frequent import commonest

from ..conftest import DATA, oracle_rows, rows_of
from .conftest import ODD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_commonest_keeps_to_its_bound(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([100, 50, 50, 7, 7, 7, 1, 1])], "w long, c long")
    assert [commonest(df, "c", k).count() for k in (0, 1, 2, 3, 5, 6, 8)] == [0, 1, 1, 3, 3, 6, 8]


def test_mix_targets_and_repeats(spark, scratch):
    sizes = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 200 else None, 10) for i in range(230)], "doc_id long, source string, size long")
    got = mixing.mix(sizes, scratch).collect()
    of = {r.source: r.target for r in got}
    assert of["a"] == 300 and of["b"] == pytest.approx(2000 * 2 / 3) or of[None] == 900
    assert sum(of.values()) == pytest.approx(2300)
    for s, target in of.items():
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in rows) - target) <= 10 and max(r.copies for r in rows) <= 3
    assert rows_of(mixing.mix(sizes, scratch)) == rows_of(mixing.mix(sizes.repartition(7), scratch))


def test_mix_on_odd_rows(spark, scratch, odd, empty):
    assert mixing.mix(mixing.sized(odd), scratch).count() == len(ODD)
    out = mixing.mixed_documents(odd, scratch)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mix(mixing.sized(empty), scratch).count() == 0 and mixing.mixed_documents(empty, scratch).count() == 0


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op2_mix_sources", "op5_minhash_dedup", "op6_url_reputation"])
def test_queries_equal_sql(spark, duck, name):
    from tidelane.llm import registry

    names, want = oracle_rows(duck, registry.oracle_sql()[name])
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == names and rows_of(df) == want


def test_hosts_and_rules(spark, scratch):
    rows = [
        (
            1, "http://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"
        ), (2, "https://x.com/en/", "x.com", "/en/", "com/en/", "block"), (3, "ftp://net/de/8#y", "net", "/de/8", "net/de/", "allow"),
        (
            4, "http://m.example.net/de/80", "m.example.net", "/de/80", "example.net/de/8", "block"
        ), (
            5, "http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/", "allow"
        ), (6, None, "", "", None, None), (7, "no scheme", "", "", None, None),
        (8, "http://h.org?q://z/", "h.org", "", None, None), (None, "x://y.org/es/a", "y.org", "/es/a", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, good int"), scratch).collect()
    by = {r.page_id: tuple(r) for r in got}
    for i, _, host, path, rule, verdict in rows:
        assert by[i][:4] == (i, host, path, rule) and by[i][4] == (verdict or "allow")


def hosts_with(bad_share, seed=3):
    """Labelled pages of 30 hosts, five of which are bad with the share given, the others with a tenth."""
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(3000):
        h = rng.randrange(30)
        pages.append((i, f"http://h{h}.{'spam.biz' if h < 5 else 'site.info'}/p{i}"))
        labels.append((i, int(rng.random() >= (bad_share if h < 5 else 0.1))))
    return pages, labels


def test_bad_hosts_are_blocked_and_unknown_ones_not(spark, scratch):
    pages, labels = hosts_with(0.7)
    pages = [*pages, (9000, "http://new.place.info/"), (9001, "http://other.spam.biz/"), (9002, "http://x.com/en/")]
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    got = {r.page_id: r.verdict for r in urls.judge(p, q, scratch).collect()}
    assert {got[i] for i, u in pages[:3000] if "spam" in u} == {"block"} and {got[i] for i, u in pages[:3000] if "site" in u} == {"allow"}
    assert got[9000] == "allow" and got[9001] == "block" and got[9002] == "block"  # a new host has its domain's reputation
    told = {r.usual: (r.pages, r.bad) for r in urls.measured(p, q, scratch).collect()}
    bad = sum(1 - g for _, g in labels)
    assert told["block"][1] / told["block"][0] > 0.6 and told["block"][1] / bad > 0.5 and told["allow"][1] / told["allow"][0] < 0.12


def test_hosts_that_differ_by_chance_only_are_allowed(spark, scratch):
    pages, labels = hosts_with(0.1)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"), scratch)
    assert got.where("verdict = 'block'").count() == 0


def test_urls_on_odd_pages(spark, scratch, tmp_path):
    long = "http://" + "a" * 100_000 + ".com/en/" + "b" * 100_000
    pages = spark.createDataFrame(
        [(1, long), (1, long), (None, None), (2, "://"), (3, "x://?#")], "page_id long, url string"
    ).withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "good", "n", "m_id", "suffix")})
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "page_id long, good int")
    got = urls.judge(pages, labels, scratch).collect()
    assert sorted((r.page_id or 0, len(r.host), r.rule, r.verdict) for r in got) == [
        (0, 0, None, "allow"), (1, 100_004, "com/en/", "block"), (1, 100_004, "com/en/", "block"), (2, 0, None, "allow"), (3, 0, None, "allow")
    ]
    assert urls.judge(pages.limit(0), labels, scratch).count() == 0 and urls.judge(pages, labels.limit(0), scratch).count() == 5
    (tmp_path / "s.dat").write_text("// comment\ncom\nco.uk // both\n*.ck\n!www.ck\n\ngov.uk\n")
    assert urls.suffixes_from(spark, str(tmp_path / "s.dat")) == ["co.uk", "gov.uk"]


def test_upper_bound_is_a_beta_quantile(spark):
    rng = np.random.default_rng(1)
    for a, b in ((3.0, 2.0), (40.0, 5.0), (300.0, 1.5)):
        got = spark.range(1).select(urls.upper_bound(F.lit(a), F.lit(b))).first()[0]
        assert abs(got - np.quantile(rng.beta(a, b, 400_000), 0.95)) < 0.04 and got < 1


def test_warc_round_trip_and_links(spark):
    html = "<html><head><title>T &amp; x</title><script>bad()</script></head><body><p>One &lt;two&gt;</p><p>three<a href='/l?a=1&amp;b=2'>four</a></body></html>"
    data = warc.build_response(1, "http://a/b", html, "2024-01-01T00:00:00Z")
    ((headers, block),) = warc.read_records(data)
    assert warc.write_record(headers, block) == data
    (mh, meta, ok), (ch, text, _) = warc.derive(headers, block)
    of, m, c = dict(headers), dict(mh), dict(ch)
    assert ok and m["WARC-Refers-To"] == c["WARC-Refers-To"] == of["WARC-Record-ID"] and m["WARC-Concurrent-To"] == c["WARC-Record-ID"]
    assert m["WARC-Target-URI"] == "http://a/b" and m["WARC-Source-Payload-Digest"] == of["WARC-Payload-Digest"] == warc.digest(html.encode())
    assert text.decode() == "One <two>\nthreefour" and b"outlink: /l?a=1&b=2 a\r\n" in meta and b"title: T & x\r\n" in meta and b"source-header: Content-Type: text/html" in meta


def test_warc_files_and_broken_records(spark):
    import gzip

    one, two = (warc.build_response(i, f"http://a/{i}", "<p>x</p>", "2024-01-01T00:00:00Z") for i in (1, 2))
    rows = [(1, gzip.compress(one) + gzip.compress(two)), (2, one + two[:-30]), (3, b"junk"), (4, None), (5, one.replace(b"<p>x", b"<p>y"))]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert Counter(r.page_id for r in got) == {1: 4, 2: 2, 5: 2}
    assert {r.page_id: r.source_digest_ok for r in got} == {1: True, 2: True, 5: False}
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    body = gzip.compress(b"hello")
    assert warc.read_http(chunked + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n")[2] == b"hello"


def test_warc_on_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "a\r\nb", "\u00e9" * 1000), (3, "a\r\nb", "\u00e9" * 1000), (3, "a\r\nb", "other")]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, html string"
    ).withColumns({c: F.lit("clash") for c in ("record", "warc_type", "error")})
    responses = warc.responses_of(pages).withColumns({c: F.lit("clash") for c in ("warc_type", "error", "url")})
    got = warc.derivatives(responses).collect()
    assert len(got) == 10 and all(r.source_digest_ok for r in got)
    of = Counter((r.page_id, r.refers_to) for r in got)
    assert sorted(of.values()) == [2, 2, 2, 4] and len({r.record_id for r in got}) == 8  # only equal rows are the same record
    assert warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0
    broken = spark.createDataFrame(
        [(1, bytearray(b"junk")), (2, bytearray(warc.build_response(2, "u", "x", "d")[:-40])), (3, None), (4, bytearray(b""))],
        "page_id long, record binary"
    )
    assert sorted((r.page_id, r.warc_type, r.error[:9]) for r in warc.derivatives(broken, errors=True).collect()) == [
        (1, "error", "no record"), (2, "error", "record at")
    ]


def test_warc_equals_brute_force_on_the_pages(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], []

        def handle_starttag(self, tag, attrs):
            self.out.append(" ")
            if tag in ("script", "style", "noscript", "template", "svg", "head"):
                self.skip.append(tag)

        def handle_endtag(self, tag):
            self.out.append(" ")
            if tag in self.skip:
                self.skip.remove(tag)

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = warc.derivatives(warc.responses_of(spark.read.parquet(f"{DATA}/pages.parquet"))).where("warc_type = 'conversion'").collect()
    assert len(got) == len(pages)
    same = 0
    for r in got:
        ((_, text),) = warc.read_records(bytes(r.record))
        p = Words()
        p.feed(pages[r.page_id].html or "")
        p.close()
        same += text.decode().replace("\n", " ").split() == "".join(p.out).split()
    assert same >= 0.97 * len(got), same


def test_warc_is_linear_in_records_members_and_open_tags():
    import gzip
    import time

    one = warc.build_response(1, "u", "<p>x</p>", "d")
    for data, n in ((one * 20_000, 20_000), (gzip.compress(one) * 20_000, 20_000)):
        began = time.process_time()
        assert sum(1 for _ in warc.read_records(data)) == n and time.process_time() - began < 5
    for bad in ("<script>", "<!--", "<a ", "<title>", "<head>", "<"):
        began = time.process_time()
        warc.html_to_text(bad * 100_000), warc.title_and_links(bad * 100_000)
        assert time.process_time() - began < 2, bad
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"1\r\na\r\n" * 200_000 + b"0\r\n\r\n"
    assert len(warc.read_http(chunked)[2]) == 200_000


def test_html_to_text_cases():
    of = warc.html_to_text
    assert of("a<!-- b --> c<script>x<b></script >d<BR>e") == "a c d\ne" and of("<style>a") == "a" and of("<!-- a") == "<!-- a" and of("a < b &amp; c") == "a < b & c"
    assert of("<head><title>t</title></head><h1>x</h1>y<li>z") == "x\ny\nz" and of("") == ""


def test_toxicity_on_held_out_labels(spark, scratch):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.query(spark, sf).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    assert sum(r.predicted == r.toxic for r in test) >= 0.95 * len(test) and all(0 <= r.score <= 1 for r in got)


def test_label_model_discounts_copies_of_a_voter_and_beats_the_majority():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    good = np.stack([np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(4)], axis=1)
    bad = np.where(rng.random(4000) < 0.65, y, ~y)
    votes = np.concatenate([good, *[bad[:, None]] * 3], axis=1).astype(int)
    post, rates, groups = toxicity.label_model(votes, np.ones(4000), 0.3)
    right, most = ((post > 0.5) == y).mean(), ((votes.sum(axis=1) >= 4) == y).mean()
    assert right > 0.93 and right > most + 0.02 and any(sorted(g) == [4, 5, 6] for g in groups) and rates[0, 0] > 0.85


def test_label_model_tells_from_votes_alone_and_weighs_patterns():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.2
    votes = np.stack(
        [np.where(y, rng.random(3000) < a, rng.random(3000) < b) for a, b in ((0.9, 0.02), (0.6, 0.01), (0.7, 0.3), (0.1, 0.1))], axis=1
    ).astype(int)
    codes, inverse, n = np.unique(votes @ [8, 4, 2, 1], return_inverse=True, return_counts=True)
    post, rates, _ = toxicity.label_model(codes[:, None] >> np.array([3, 2, 1, 0]) & 1, n.astype(float), 0.2)
    assert ((post[inverse] > 0.5) == y).mean() > 0.95 and np.abs(rates[:, 3] - 0.1).max() < 0.05


def test_bare_words():
    raw = "\u00ab\u00c9t\u00e9\u00bb, \u201cIdiot!\u201d it\u2019s a--b #x\u00d7y".encode()
    w = toxicity.bare_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [w.data[i:j].tobytes().decode() for i, j in zip(w.starts, w.ends)] == ["\u00e9t\u00e9", "idiot", "it", "s", "a", "b", "x\u00d7y"]
    other = "\u00e9t\u00e9 IDIOT".encode()
    x = toxicity.bare_words(np.frombuffer(other, np.uint8), np.array([0, len(other)]))
    assert x.hashes().tolist() == w.hashes()[:2].tolist() and x.beginnings(4).tolist() == w.beginnings(4)[:2].tolist() and w.beginnings(4)[2] == 0


def test_toxicity_learns_planted_words_of_any_text_length(spark, scratch):
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(300)], ["zorkish", "zorkable", "blargful"]
    docs, labels = [], []
    for d in range(600):
        w = [rng.choice(plain) for _ in range(rng.choice((5, 50, 500)))]
        toxic = d % 5 == 0
        for _ in range(toxic * max(1, len(w) // 50)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame.where("doc_id < 400"), spark.createDataFrame(labels[:300], "doc_id long, toxic int"), scratch)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(frame, model).collect()}
    assert sum(got[d] == bool(t) for d, t in labels[400:]) >= 195
    again = toxicity.score(frame.withColumn("doc_id", frame.doc_id + 5000).repartition(3), model).collect()
    assert {r.doc_id - 5000: r.score >= 0.5 for r in again} == got


def test_toxicity_on_odd_rows(spark, scratch, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, scratch)
    assert toxicity.score(odd, model).count() == len(ODD)
    clean = (np.zeros_like(model[0]), -5.0, model[2])
    kept = toxicity.reject_toxic(odd, clean)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))
    assert toxicity.score(empty, toxicity.fit(empty, labels, scratch)).count() == 0
    assert toxicity.reject_toxic(empty, model).count() == 0
    assert toxicity.fit(odd, labels.limit(0), scratch)[1] == -30.0


def base_counts(docs):
    count = Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            count.update([*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None])
    return count


def test_language_scores(spark, scratch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [r[:2] for r in ODD]
    got = maxent_lm.language_scores(spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()
    count = base_counts(docs)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t in docs:
        tokens = [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        want[
            d, len(tokens), sum(count[w] > 0 for w in tokens), n, round(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 4)
        ] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent_lm.language_scores(spark.createDataFrame([], "doc_id long, text string"), scratch).count() == 0


def test_quality_counts(spark, scratch):
    rng = random.Random(4)
    docs = [(
        i, "\n".join(" ".join(rng.choice("ab # c d <x> ef".split(" ")) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30))), "en"
    ) for i in range(150)]
    docs += [(1000 + i, r[1], r[2]) for i, r in enumerate(ODD)]
    for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string"), scratch).collect():
        t = next(d[1] for d in docs if d[0] == r.doc_id) or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        found, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if found[tuple(w[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        want = (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w)
        )
        assert tuple(r)[1:7] == want, t
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_and_rejects_bad(spark, scratch):
    sf = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.query(spark, sf).join(labels, "doc_id").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good if not r.base_failed) >= 0.98 * sum(not r.base_failed for r in good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_distance_bounds(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([], [1.0])], "p array<double>, q array<double>")
    assert [round(r.d, 6) for r in quality.with_js_distance(df, "d", "p", "q").select("d").collect()] == [1.0, 0.0, 0.0]


def test_pipeline(spark, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "passage_dedup", "mix_sources", "bpe"]
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() <= 3 * docs.count() and out.where(F.col("n_tokens") != F.size("ids")).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, DATA).columns == empty.columns, name
