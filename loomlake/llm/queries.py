"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bm25, decontaminate, line_dedup, near_dedup, pieces, quality, sharding, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (toxicity.op1_toxicity, quality.op2_quality_classifier, sharding.op3_sharding, line_dedup.op4_line_dedup, bm25.op5_exact_topk_search, decontaminate.op6_benchmark_decontamination, near_dedup.op7_minhash_near_dedup, token_counts.op8_token_counts, pieces.op9_sentencepiece, url_filter.op10_url_filters)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.ORACLE, "op5_exact_topk_search": bm25.ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE, "op7_minhash_near_dedup": near_dedup.ORACLE, "op10_url_filters": url_filter.ORACLE}
