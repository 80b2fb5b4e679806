"""Index and search parameters (fixed default values), stored beside an index as a one-row table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row, SparkSession

CHUNK_SIZE = 100
CHUNK_OVERLAP = 10
EMBEDDING_DIM = 768
VECTOR_TOP_K = 3
LEXICAL_TOP_K = 10
TERM_LOOKUP_LIMIT = 10
DROP_SCORE = 0.5
RRF_K = 60


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.3
    b: float = 0.6
    # The analyzer: whether runs of Han characters are indexed and asked as pairs.
    han_bigrams: bool = False


@dataclass(frozen=True)
class IvfParams:
    metric: str = "cosine"
    nlist: int = 2048
    nprobe: int = 10


def write_params(spark: SparkSession, params: Bm25Params | IvfParams, path: str) -> None:
    spark.createDataFrame([Row(**asdict(params))]).coalesce(1).write.mode("overwrite").parquet(path)


def read_params(spark: SparkSession, kind: type, path: str):
    return kind(**spark.read.parquet(path).first().asDict())
