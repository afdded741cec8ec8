"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, embed_dedup, maxent_lm, minhash, mixing, paragraphs, quality, toxicity, urls, warc


def queries() -> dict:
    return {
        "op1_embedding_dedup": embed_dedup.query,
        "op2_mix_sources": mixing.query,
        "op3_bpe": bpe.query,
        "op4_warc_derivatives": warc.query,
        "op5_minhash_dedup": minhash.query,
        "op6_url_reputation": urls.query,
        "op7_toxicity": toxicity.query,
        "op8_maxent_scores": maxent_lm.query,
        "op9_passage_dedup": paragraphs.query,
        "op10_quality_divergence": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embed_dedup.SQL,
        "op2_mix_sources": mixing.SQL,
        "op5_minhash_dedup": minhash.SQL,
        "op6_url_reputation": urls.SQL,
    }
