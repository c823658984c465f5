"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import mixing, near_dup, neighbours, packing, quality, secrets, sharding, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.query,
    "op2_url_filter": url_filter.query,
    "op3_source_mix": mixing.query,
    "op4_secrets": secrets.query,
    "op5_token_counts": token_counts.query,
    "op6_near_duplicates": near_dup.query,
    "op7_hilbert_shards": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_nearest": neighbours.query,
    "op10_best_fit_packing": packing.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_source_mix": mixing.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op7_hilbert_shards": sharding.ORACLE,
}
