"""Combining hit lists and assembling prompt text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.common import rounded, top_k
from docquarry.params import RRF_K


def fuse_rrf(lexical: DataFrame, vector: DataFrame, id_col: str, top_n: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: each list adds ``1 / (k + rank)``.

    A union and one aggregation give the full outer join of the two lists, with one shuffle.
    """
    parts = [
        hits.select("query_id", id_col, F.lit(name).alias("source"), "rank")
        for name, hits in (("lexical", lexical), ("vector", vector))
    ]
    rank_in = {n: F.max(F.when(F.col("source") == n, F.col("rank"))) for n in ("lexical", "vector")}
    fused = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_id", id_col)
        .agg(rank_in["lexical"].alias("lexical_rank"), rank_in["vector"].alias("vector_rank"))
    )
    share = [F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0)) for c in ("lexical_rank", "vector_rank")]
    fused = fused.withColumn("score", rounded(share[0] + share[1]))
    if top_n is None:
        return fused
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc(id_col)], top_n)


def assemble_context(hits: DataFrame, top_n: int, content: str = "content", separator: str = "\n") -> DataFrame:
    """Contents of the first ``top_n`` hits of each query, in rank order, as one text.

    ``top_n`` bounds the group, so the list that is collected is small.
    """
    entry = F.struct(F.col("rank"), F.col(content).alias("content"))
    return (
        hits.filter(F.col("rank") <= top_n)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("__parts"))
        .select(
            "query_id",
            F.size("__parts").alias("n_chunks"),
            F.concat_ws(separator, F.transform("__parts", lambda p: p["content"])).alias("context"),
        )
    )


def chat_prompt(
    turns: DataFrame, piece_turns: int, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Conversation history as ``role: text`` lines in turn order.

    Rows ``(key, piece, n_turns, prompt)``, keyed by conversation and piece: piece i holds the turns from
    i * ``piece_turns`` on, so what one row collects is bounded by the caller's choice, and nothing is left out.
    """
    line = F.struct(F.col(turn).alias("turn"), F.concat(F.col(role), F.lit(": "), F.col(text)).alias("line"))
    return (
        turns.groupBy(key, F.floor(F.col(turn) / piece_turns).cast("long").alias("piece"))
        .agg(F.array_sort(F.collect_list(line)).alias("__lines"))
        .select(
            key, "piece", F.size("__lines").alias("n_turns"),
            F.concat_ws("\n", F.transform("__lines", lambda x: x["line"])).alias("prompt"),
        )
    )


def history_prompt(history: str | Column, question: str | Column) -> Column:
    """Chat history list and question as one prompt text."""
    history = F.col(history) if isinstance(history, str) else history
    question = F.col(question) if isinstance(question, str) else question
    return F.concat_ws("\n", F.concat(history, F.array(question)))
