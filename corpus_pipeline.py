"""Corpus pipeline: quality rules, near-dedup, secret scan, source mix, packing.

Defined cases of all stages: columns of documents beyond those a stage needs are kept, whatever their
names, up to the packing, which has columns of its own; an empty table gives an empty result at each
stage; texts of any length are read whole; tables are told apart by nothing but their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import mixing, near_dup, packing, quality, secrets
from skarn.llm.common import store, table
from skarn.plans.scratch import discard


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees reject go.

    A null text counts as empty; null ids are scored like any other; repeated rows share their fate;
    without labels of both classes every document stays.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest doc_id.

    Null and empty texts and null ids are in no group and stay; of rows that repeat a doc_id one stays.
    """
    return near_dup.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked.

    Null and empty texts have none; n_chars follows a text that changed; repeated rows are masked each.
    """
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture by target weights, cut at each source's budget, repeated by epoch.

    A null source is a source of its own; a text without words is never taken; ties of key and doc_id
    go by token count; repeated rows count each.
    """
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of pieces of documents.

    A null doc_id is packed as null; documents without words are in no bin; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Trees and MinHash aren't SQL: tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is written and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, name)
            discard(last)
    return docs
