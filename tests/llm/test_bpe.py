import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelane.llm import bpe

from ..conftest import DATA
from .conftest import ODD, SCHEMA

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


WORDS = (
    "The the don't we'll 'S 'stop it's's x'rest '''s \"'t 're've i'm'm o'd l'L İstanbul ΣΑΣ ß naïve é 123 a1b2 !!! <|endoftext|> x<|startoftext|>y 日本語 \U0001f642\U0001f44d\U0001f3fd "
    "\x1c a\x1cb \x85 \xa0 ½ ٣ ǅ aaaaaaaaaa '' 't're é ’s “q” 　z   a b \x00 K ẞ"
).split(" ")


def mixed_texts():
    rng = random.Random(0)
    out = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(300)]
    out += ["".join(chr(rng.choice([
        rng.randrange(32, 127), rng.randrange(1, 0x350), rng.randrange(0x2000, 0x2150), rng.randrange(0x370, 0x530), rng.randrange(0x900, 0xD7FF)
    ])) for _ in range(40)) for _ in range(600)]
    out += ["".join(rng.choice("'stmdrevl! 1\n") for _ in range(60)) for _ in range(300)]
    out += ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (39, 40, 41, 99, 100, 101, 3000)]
    return [*out, "", None, "one two " * 70_000, "\n", " <|endoftext|>", "<|endoftext|><|endoftext|>"]


def test_encoding_and_decoding_equal_the_library(vocabulary):
    theirs, texts = Tokenizer.from_file(PATH), mixed_texts()
    common = [b"the", b"123", b"!!!", "naïve".encode(), b"thee", b"'s", b"1"]
    writer = bpe.Writer(vocabulary.tokens)
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    for lexicon in (None, bpe.compile_lexicon(dict(zip(common, bpe.Merger(vocabulary).merge_many(common), strict=True)))):
        encoder = bpe.Encoder(vocabulary, lexicon)
        ids, n = encoder.encode(texts)
        for t, own, w in zip(texts, np.split(ids, np.cumsum(n)[:-1]), want, strict=True):
            assert own.tolist() == w, ascii(t)[:200]
        digits, decoded = writer.digits(ids, n), writer.decoded(ids, n)
        assert [d.decode() for d in digits] == [" ".join(map(str, w)) for w in want]
        assert [d.decode() for d in decoded] == [theirs.decode(w, skip_special_tokens=False) for w in want]
        assert encoder.encode([])[0].tolist() == [] and encoder.encode([None, ""])[1].tolist() == [0, 0]


def test_every_code_point_alone_and_between_letters(vocabulary):
    theirs, encoder = Tokenizer.from_file(PATH), bpe.Encoder(vocabulary, None)
    texts = [t for c in range(0x3100) for t in (chr(c), f"a{chr(c)}b {chr(c)}1{chr(c)}'s")]
    ids, n = encoder.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == theirs.encode(t, add_special_tokens=False).ids, ascii(t)


def test_lexicon_shares_suffixes_and_finds_exactly_its_words():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["nation", "station", "stations", "ration", "a", "é", "x" * 40])}
    block = bpe.compile_lexicon(words)
    held = bpe.Lexicon(block)
    asked = [*words, b"stat", b"nations", b"b", b"ratio", b"x" * 41, b"x" * 39, b"\xff"]
    size = np.array([len(w) for w in asked])
    got = held.numbers(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    assert [held.ids[held.start[i] : held.start[i + 1]].tolist() if i >= 0 else None for i in got] == [words.get(w) for w in asked]
    assert int(np.frombuffer(block, np.uint32)[0]) < sum(len(w) for w in words) - 8


def test_digests_of_documents(spark, odd, empty, vocabulary):
    theirs = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame(ODD, SCHEMA))
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = Counter()
    for (d, t), n in texts.items():
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want[
            d, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False)))
        ] += n
    assert Counter(map(tuple, bpe.text_digests(docs, PATH).collect())) == want
    assert bpe.text_digests(empty, PATH).count() == 0 and bpe.text_digests(odd, PATH).count() == len(ODD)
    coded = bpe.encode_documents(docs, vocabulary, None, digests=True)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == want
    back = bpe.decode_documents(coded.drop("text"), vocabulary)
    assert {hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in back.collect()} == {True}
    assert bpe.encode_documents(odd, vocabulary, None).columns == [*(c for c in odd.columns if c != "ids"), "ids"]
