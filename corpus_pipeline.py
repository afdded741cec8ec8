"""The corpus pipeline: documents pass through STAGES, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import bpe, minhash, mixing, paragraphs, toxicity
from tidelane.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones among them, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(5))
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels, Scratch(spark, "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles at a similarity of 0.8 link."""
    return minhash.first_of_groups(docs, Scratch(spark, "near"))


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the passages that an earlier one holds."""
    return paragraphs.strip_repeats(docs, Scratch(spark, "passages"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixing.mixed_documents(docs, Scratch(spark, "mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their text's token ids in its place, their number, and digests of ids and of what they decode to."""
    import public_tokenizers

    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_documents(docs, v, bpe.build_lexicon(docs, v, Scratch(spark, "bpe")), digests=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("passage_dedup", strip_repeats),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The classifier's weights can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. Each result is a table in the shared folder, read by the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch"):
            scratch.drop(before)
    return docs
