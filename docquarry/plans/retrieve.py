"""Queries to fused, reranked hits and prompt context.

Hybrid retrieval as intended for the chat path: lexical and vector hits, fusion, optional rerank, context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.fusion import assemble_context, fuse_rrf
from docquarry.operators.ivf import IvfIndex, knn_ivf
from docquarry.operators.knn import knn_exact
from docquarry.operators.lexical import TextIndex, bm25_search
from docquarry.operators.rerank import rerank
from docquarry.params import LEXICAL_TOP_K
from docquarry.session import BROADCAST_MAX_ROWS, fits_broadcast


def retrieve(
    queries: DataFrame, index: TextIndex, chunks: DataFrame, k: int = LEXICAL_TOP_K, top_n: int = LEXICAL_TOP_K,
    reranked: bool = True, score: Column | None = None, fuzzy: bool = True, where: Column | None = None,
    cells: IvfIndex | None = None, exact_cells: bool = True, part: Column | None = None,
    fields: tuple[str, ...] = (),
) -> DataFrame:
    """``queries`` has (query_id, text, query_vector); ``chunks`` has the index's id, content, embedding.

    Returns ``(query_id, rank, <id>, score, content, *fields)``: lexical and vector hits fused, then with
    ``reranked`` put in the order of the pair score; ``fields`` are further columns of ``chunks``. Query
    terms match near terms too (``fuzzy``). ``where`` restricts both halves by columns that the chunks
    and the text index have in common; nothing outside it is scored, counted or returned. With
    ``cells``, a cluster index of the vectors, the hits are found in its cells (``exact_cells``: read until no
    other can hold a better hit; else the nearest ones only). ``part`` restricts like ``where``, by columns that
    the cluster index is partitioned by: folders outside it are not read.
    """
    id_col = index.id_col
    both = where if part is None else part if where is None else part & where
    if both is not None:
        chunks = chunks.filter(both)
    lexical = bm25_search(queries, index, k, fuzzy=fuzzy, where=both)
    if cells is not None:
        vector = knn_ivf(queries, cells, k, exact=exact_cells, part=part, where=where)
    else:
        vector = knn_exact(queries, chunks, k, id_col=id_col)
    fused = fuse_rrf(lexical, vector, id_col, top_n=2 * k)
    # There are at most 2k fused rows per query, so counting the queries bounds them.
    few = fits_broadcast(queries.select("query_id"), BROADCAST_MAX_ROWS // (2 * k))
    hits = chunks.select(id_col, "content", *fields).join(F.broadcast(fused) if few else fused, id_col)
    if not reranked:
        return hits.filter(F.col("rank") <= top_n).select("query_id", "rank", id_col, "score", "content", *fields)
    pairs = hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select(
        "query_id", id_col, "query", F.col("content").alias("document"), (F.col("rank") - 1).alias("index"), *fields
    )
    best = rerank(pairs, score, top_n)
    return best.select(
        "query_id", "rank", id_col, F.col("relevance_score").alias("score"), F.col("document").alias("content"), *fields
    )


def retrieve_context(queries: DataFrame, index: TextIndex, chunks: DataFrame, top_n: int = LEXICAL_TOP_K, **options) -> DataFrame:
    """One context text per query."""
    return assemble_context(retrieve(queries, index, chunks, top_n=top_n, **options), top_n)
