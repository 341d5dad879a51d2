"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, html_extraction, line_dedup, merkle, mixing, ngram_join, pii, quality, topk, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_pii": pii.query,
        "op3_ngram_join": ngram_join.query,
        "op4_chat": chat.query,
        "op5_line_dedup": line_dedup.query,
        "op6_mixing": mixing.query,
        "op7_topk": topk.query,
        "op8_bpe": bpe.query,
        "op9_quality": quality.query,
        "op10_toxicity": toxicity.query,
        "op11_html": html_extraction.query,
        "op12_merkle": merkle.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same: chat formatting, mixing, top-k search and manifests."""
    return {"op4_chat": chat.SQL, "op6_mixing": mixing.SQL, "op7_topk": topk.SQL, "op12_merkle": merkle.SQL}
