"""Exact vector search.

Two ways give the same rows. Few queries, checked: their matrix is broadcast and every scan task
keeps its own best ``k`` per query. Many queries: queries and vectors are cut into blocks of
bounded size, each pair of blocks meets in one group, and the groups' best ``k`` are merged.
Either way at most ``k`` rows per query and task are shuffled to the final ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.common import SCORE_DIGITS, top_k
from docquarry.params import VECTOR_TOP_K

METRICS = ("cosine", "ip", "l2")

# Largest query matrix that is broadcast, in values (8 bytes each).
BROADCAST_VALUES = 4_000_000
BLOCK_QUERIES = 2_000
BLOCK_VECTORS = 20_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    if not len(column):
        return np.empty((0, dimensions))
    return np.stack(column.to_numpy()).astype(np.float64)


def pair_scores(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Score of every vector (row) for every query (column); for ``l2`` the distance."""
    if metric == "cosine":
        scores = _unit(vectors) @ _unit(queries).T
    elif metric == "ip":
        scores = vectors @ queries.T
    else:
        scores = np.stack([np.sqrt(((vectors - q) ** 2).sum(axis=1)) for q in queries], axis=1)
    return np.round(scores, SCORE_DIGITS)


def best_pairs(ids: pd.Series, scores: np.ndarray, query_ids: np.ndarray, k: int, descending: bool) -> pd.DataFrame:
    """Best ``k`` rows of each query column, ties by id."""
    if not scores.size:
        return pd.DataFrame({"query_id": [], "id": [], "score": []})
    keyed = -scores if descending else scores
    if len(ids) > k:
        bar = np.partition(keyed, k - 1, axis=0)[k - 1]
        rows, cols = np.nonzero(keyed <= bar)
    else:
        rows, cols = (a.ravel() for a in np.indices(scores.shape))
    found = pd.DataFrame(
        {"col": cols, "key": keyed[rows, cols], "id": ids.to_numpy()[rows], "score": scores[rows, cols]}
    )
    found = found.sort_values(["col", "key", "id"], kind="stable").groupby("col", sort=False).head(k)
    return pd.DataFrame(
        {"query_id": query_ids[found["col"].to_numpy()], "id": found["id"].to_numpy(), "score": found["score"].to_numpy()}
    )


def _result_schema(queries: DataFrame, vectors: DataFrame, query_id: str, id_col: str) -> str:
    return (
        f"query_id {queries.schema[query_id].dataType.simpleString()}, "
        f"id {vectors.schema[id_col].dataType.simpleString()}, score double"
    )


def bounded_rows(queries: DataFrame, vector_col: str) -> pd.DataFrame | None:
    """The queries, when their matrix is within the broadcast bound; else None. Reads no more than that."""
    first = queries.select(F.size(vector_col)).first()
    if first is None:
        return queries.toPandas()
    limit = max(1, BROADCAST_VALUES // max(1, first[0]))
    rows = queries.limit(limit + 1).toPandas()
    return rows if len(rows) <= limit else None


def knn_exact(
    queries: DataFrame, vectors: DataFrame, k: int = VECTOR_TOP_K, metric: str = "cosine",
    query_id: str = "query_id", query_vector: str = "query_vector",
    id_col: str = "chunk_id", vector_col: str = "embedding", where: Column | None = None,
) -> DataFrame:
    """Best ``k`` vectors of each query: ``(query_id, rank, <id>, score)``.

    ``where`` restricts the vectors before scoring. Null vectors are no neighbours, null queries have none. For ``l2`` the score is a distance and small is good.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if where is not None:
        vectors = vectors.filter(where)
    queries = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    # Null vectors are left out inside the search: a filter here would be pushed below an exchange and compute the
    # vectors of a UDF a second time.
    vectors = vectors.select(id_col, vector_col)
    rows = bounded_rows(queries, query_vector)
    if rows is not None:
        found = _scan(rows, queries, vectors, k, metric, query_id, query_vector, id_col, vector_col)
    else:
        found = block_search(
            queries.withColumn("cell", F.lit(0)), vectors.withColumn("cell", F.lit(0)),
            k, metric, query_id, query_vector, id_col, vector_col,
        )
    return rank_found(found, k, metric, id_col)


def rank_found(found: DataFrame, k: int, metric: str, id_col: str) -> DataFrame:
    order = F.asc("score") if metric == "l2" else F.desc("score")
    ranked = top_k(found, ["query_id"], [order, F.asc("id")], k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _scan(rows, queries, vectors, k, metric, query_id, query_vector, id_col, vector_col) -> DataFrame:
    dimensions = len(rows[query_vector].iloc[0]) if len(rows) else 0
    shared = queries.sparkSession.sparkContext.broadcast(
        (rows[query_id].to_numpy(), _matrix(rows[query_vector], dimensions))
    )
    descending = metric != "l2"

    def search(batches):
        query_ids, matrix = shared.value
        if not len(query_ids):
            return
        best = None
        for batch in batches:
            batch = batch[batch[vector_col].notna()]
            scores = pair_scores(_matrix(batch[vector_col], matrix.shape[1]), matrix, metric)
            found = best_pairs(batch[id_col], scores, query_ids, k, descending)
            best = found if best is None else merge_pairs([best, found], k, descending)
        if best is not None:
            yield best

    return vectors.mapInPandas(search, _result_schema(queries, vectors, query_id, id_col))


def merge_pairs(parts: list[pd.DataFrame], k: int, descending: bool) -> pd.DataFrame:
    both = pd.concat(parts, ignore_index=True)
    both = both.sort_values(["score", "id"], ascending=[not descending, True], kind="stable")
    return both.groupby("query_id", sort=False).head(k)


def block_search(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str,
    query_id: str, query_vector: str, id_col: str, vector_col: str,
    block_queries: int = BLOCK_QUERIES, block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """Search inside each ``cell``, by pairs of bounded blocks.

    A cell's rows are spread by hash over as many blocks as its size asks for, so a cell that
    holds a third of the table is many groups, none larger than about two blocks.
    """
    sizes = (
        queries.groupBy("cell").agg(F.count("*").alias("nq"))
        .join(vectors.groupBy("cell").agg(F.count("*").alias("nv")), "cell")
        .select(
            "cell",
            F.ceil(F.col("nq") / block_queries).cast("int").alias("q_blocks"),
            F.ceil(F.col("nv") / block_vectors).cast("int").alias("v_blocks"),
        )
    )
    # One row per cell: bounded by the number of lists of the index.
    sizes = F.broadcast(sizes)
    descending = metric != "l2"
    keys = ["cell", "q_block", "v_block"]

    def numbered(df: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(own_id), F.col(f"{own}_blocks")).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return (
            df.join(sizes, "cell")
            .withColumn(f"{own}_block", mine).withColumn(f"{other}_block", meets)
            .drop("q_blocks", "v_blocks")
        )

    left = numbered(queries, "q", query_id, "v")
    right = numbered(vectors, "v", id_col, "q")

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v[v[vector_col].notna()]
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        dimensions = len(q[query_vector].iloc[0])
        scores = pair_scores(_matrix(v[vector_col], dimensions), _matrix(q[query_vector], dimensions), metric)
        return best_pairs(v[id_col], scores, q[query_id].to_numpy(), k, descending)

    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInPandas(search, _result_schema(queries, vectors, query_id, id_col))
    )
