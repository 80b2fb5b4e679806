"""From raw documents to token counts: what stays, what goes, what is masked, and its encoding.

Quality rules reject documents (their own rules and their host's verdict), of near copies one stays,
documents with benchmark passages go, secrets are masked, and what is left is encoded. Every stage works
on all rows its predecessor kept and is written as Parquet before the next one reads it.

Null texts are too short for the quality rules and go there; an empty table passes through all stages;
further columns of ``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import decontaminate, host_quality, jaccard_join, secrets
from docquarry.llm.common import table
from docquarry.llm.queries import BPE_FILE, encoded_documents
from docquarry.session import materialise, scratch_mark, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies: shingles of five words, similarity of 0.8.
NEAR_COPIES = jaccard_join.JaccardJoin(n=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    ship_package(spark)
    return host_quality.keep_good(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, join=NEAR_COPIES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    ship_package(spark)
    return secrets.mask_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text, per document."""
    ship_package(spark)
    return encoded_documents(docs, public_tokenizers.path(BPE_FILE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_dedup", jaccard_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_masking", secret_masking),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages only the stage's result is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = scratch_mark()
        result = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return result
        docs = materialise(result, name, release_since=mark)
    return docs


# Grammar inference and connected near copies have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None
