"""Quality rules: plain counts, and distance of a document's histograms from its language's. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COMMON = 32  # words of a language's histogram
COMMON_LENGTH = math.inf  # code points of a common word: no limit
MIN_WORDS = 50  # shorter documents aren't judged by their common words
MIN_REFERENCE = 2000  # words of a language that make a reference
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.4
SLOTS = 1024  # of a language's table that tells most words that aren't common without comparing them
SMALL = r"[a-z\xDF-\xFF]+"  # in none of the classes that are counted
_CODES = "".join(chr(c) for c in range(ord("0"), ord("0") + COMMON + 1))


def _count(pattern: str, text: str) -> Column:
    """Code points of text in the character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{pattern}]+", ""))).cast("long")


def with_classes(df: DataFrame) -> DataFrame:
    """df with cl, the histogram of t over upper case, digits, punctuation, white space and the rest, and n_symbols.

    Blanks and small Latin letters, most of a text, are cut out once before the classes that hold none of them are counted.
    """
    x = df.withColumn("__u", F.replace("t", F.lit(" "), F.lit(""))).withColumn("__r", F.regexp_replace("__u", SMALL, ""))
    blanks = (F.length("t") - F.length("__u")).cast("long")
    named = [*(_count(k, "__r") for k in (r"\p{Lu}", "0-9", r"\p{Punct}")), blanks + _count(r"\x09-\x0D", "__r")]
    symbols = _count(SYMBOLS.replace("|", r"\|").replace("&", r"\&"), "__r")
    x = x.withColumns({"__named": F.array(*named), "n_symbols": symbols})
    rest = F.length("t").cast("long") - F.aggregate("__named", F.lit(0).cast("long"), lambda a, v: a + v)
    return x.withColumn("cl", F.concat("__named", F.array(rest))).drop("__u", "__r", "__named")


def with_js_distance(df: DataFrame, name: str, p: str, q: str) -> DataFrame:
    """df with name: the Jensen-Shannon distance, from 0 to 1, of the histograms p and q, arrays of doubles.

    It is 0 where either is empty. Totals and terms are columns of their own, for what stands inside a lambda
    is computed anew for each element.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    x = df.withColumns({"__tp": total(p), "__tq": total(q)})
    each = F.zip_with(p, q, lambda a, b: part(a / F.col("__tp"), b / F.col("__tq")) + part(b / F.col("__tq"), a / F.col("__tp")))
    some = (F.col("__tp") > 0) & (F.col("__tq") > 0)
    return x.withColumn(name, F.when(some, F.sqrt(F.greatest(F.lit(0.0), total(each) / 2))).otherwise(0.0)).drop("__tp", "__tq")


def references(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(ref_lang, ref_words, common, word_counts, class_counts, slots) of each language of docs, null among them.

    common holds its commonest words, in lower case and of any length; word_counts how often each stands, and all
    others together at the end. All words of all documents count, each document once a row. slots tells of each
    of SLOTS values whether it is the slot() of a common word.
    """
    t = docs.select("lang", F.coalesce("text", F.lit("")).alias("t"))
    sums = [F.sum(F.col("cl")[i]).cast("double") for i in range(5)]
    whole = with_classes(t).groupBy("lang").agg(F.array(*sums).alias("class_counts"))
    words = t.select("lang", F.explode(F.split(F.lower("t"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    counted = scratch.table(words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c")))
    top = _top(counted)
    sizes = counted.groupBy(F.col("lang").alias("size_lang")).agg(F.sum("c").alias("size"))
    x = whole.join(top, whole.lang.eqNullSafe(top.top_lang), "left").join(sizes, whole.lang.eqNullSafe(sizes.size_lang), "left")
    x = x.withColumn("ref_words", F.coalesce("size", F.lit(0).cast("long")))
    seen = F.coalesce(F.transform("top", lambda s: s["c"].cast("double")), F.array().cast("array<double>"))
    rest = F.col("ref_words").cast("double") - F.aggregate(seen, F.lit(0.0), lambda a, v: a + v)
    x = x.select(
        F.col("lang").alias("ref_lang"), "ref_words",
        F.coalesce(F.transform("top", lambda s: s["w"]), F.array().cast("array<string>")).alias("common"),
        F.concat(seen, F.array(rest)).alias("word_counts"), "class_counts"
    ).withColumn("taken", F.transform("common", slot))
    every = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    return scratch.table(x.withColumn("slots", F.transform(every, lambda s: F.array_contains("taken", s))).drop("taken"))


def slot(word: Column) -> Column:
    """A word's place, by its hash, among SLOTS."""
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _top(counted: DataFrame) -> DataFrame:
    """The COMMON commonest words by language, ranked within hashed parts first."""
    parts = counted.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64)))
    order = [F.desc("c"), F.col("w")]
    few = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= COMMON)
    best = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= COMMON)
    return best.groupBy(F.col("lang").alias("top_lang")).agg(F.array_sort(F.collect_list(F.struct("r", "c", "w"))).alias("top"))


def repeated_words() -> Column:
    """Words in 8-word windows that the text holds twice or more, from hs, the hashes of its windows."""
    bound = """
      aggregate(transform(array(array_sort(transform(hs, (h, i) -> struct(h, i)))), s ->
        aggregate(transform(array(array_sort(transform(
            filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))), p ->
          aggregate(transform(p, (x, k) -> least({w}, coalesce(get(p, k + 1) - x, {w}))), 0L, (a, v) -> a + v)), 0L, (a, v) -> a + v)), 0L, (a, v) -> a + v)"""
    return F.when(F.size(F.array_distinct("hs")) < F.size("hs"), F.expr(bound.format(w=WINDOW))).otherwise(F.lit(0).cast("long"))


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): the counts, base_failed, the distances, and kept.

    Words are `[^\\x20\\x09-\\x0D]+`; null counts as empty. A document is kept if it passes the base rules and
    its character classes and common words are within MAX_CLASS_DISTANCE and MAX_WORD_DISTANCE of its
    language's. Common words don't judge a document of under MIN_WORDS words, and neither distance one whose
    language has under MIN_REFERENCE; the base rules leave none of under 20 words. Null is a language of its own.
    Of words that are equally common the smaller ones go first. Repeated rows count and are judged each; an empty
    table gives an empty result; other columns are not looked at.
    """
    refs = references(docs, scratch)
    if refs.count() <= 2000:  # as many languages at most; more are joined by shuffle
        refs = F.broadcast(refs)
    t = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    t = t.join(refs, t.lang.eqNullSafe(F.col("ref_lang")), "left")
    words = F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda s: F.rlike(s, F.lit(WORD)))
    a = with_classes(t).withColumn("words", words).withColumn("lines", lines)
    codes = F.lit(["", *_CODES[1:]])
    place = lambda w: F.array_position("common", w).cast("int")
    code = lambda w: F.when(F.get("slots", slot(F.lower(w))), F.get(codes, place(F.lower(w)))).otherwise("")
    b = a.select(
        "doc_id", "ref_words", "word_counts", "class_counts", "cl", F.size("words").cast("long").alias("n_words"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"), F.array_join(F.transform("words", code), "").alias("s"), F.size("common").alias("k"),
    )
    c, size = b, 1
    while size < WINDOW:  # hashes of 2, 4, 8 words from two halves; those that reach over the end are cut off
        c, size = c.withColumn("wh", F.expr(f"transform(wh, (h, i) -> xxhash64(h, get(wh, i + {size})))")), 2 * size
    c = c.withColumn("hs", F.slice("wh", 1, F.greatest(F.size("wh") - WINDOW + 1, F.lit(0))))
    in_s = lambda ch: F.length("s") - F.length(F.replace(F.col("s"), F.lit(ch)))
    found = F.array(*(in_s(ch) for ch in _CODES[1:]))
    hist = F.concat(
        F.transform(F.slice(found, 1, F.greatest(F.col("k"), F.lit(0))), lambda v: v.cast("double")), F.array((F.col("n_words") - F.length("s")).cast("double"))
    )
    n_chars = F.aggregate("cl", F.lit(0).cast("long"), lambda x, v: x + v)
    d = c.select(
        "doc_id", "n_words", (n_chars - F.col("cl")[3]).alias("word_chars"), "n_symbols", "n_dup_lines", repeated_words().alias("n_repeat_words"), "ref_words",
        F.transform("cl", lambda v: v.cast("double")).alias("p_class"), "class_counts", hist.alias("p_word"), "word_counts",
    )
    d = with_js_distance(with_js_distance(d, "class_distance", "p_class", "class_counts"), "word_distance", "p_word", "word_counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    judged = F.coalesce("ref_words", F.lit(0)) >= MIN_REFERENCE
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~(judged & far)).alias("kept"), "class_distance", "word_distance"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole documents table."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op10")).drop("class_distance", "word_distance")
