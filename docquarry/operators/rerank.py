"""Reordering candidates by a pair score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import token_overlap
from docquarry.operators.common import rounded, top_k
from docquarry.operators.segments import MAX_GROUP_ROWS, Ordered

# A scorer factory is called once per task and returns a function of paired texts.
ScorerFactory = Callable[[], Callable[[list[str], list[str]], np.ndarray]]


def pair_documents(requests: DataFrame, documents: str = "documents") -> DataFrame:
    """One row per document of each request, with its 0-based ``index``."""
    keep = [c for c in requests.columns if c != documents]
    return requests.select(*keep, F.posexplode(documents).alias("index", "document"))


def model_scorer(scorer: ScorerFactory, query: str = "query", document: str = "document") -> Column:
    """Score column of a plug-in scorer, fed Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer()
        for left, right in batches:
            yield pd.Series(np.asarray(model(left.tolist(), right.tolist()), dtype=float), index=left.index)

    return score(F.col(query), F.col(document))


def rerank(
    candidates: DataFrame, score: Column | None = None, top_n: int | str | None = None,
    by: list[str] | None = None, max_candidates: int | None = None,
) -> DataFrame:
    """Candidates in order of falling score, ties in input order, at most ``top_n`` per request.

    ``candidates`` has ``query``, ``document`` and ``index`` (input position). ``top_n`` is a
    number or the name of a per-request column; null keeps all and 0 keeps none. A number lets
    Spark cut each group before the shuffle. Otherwise all candidates are ranked: ``max_candidates``
    is a bound per request where one is known, else the largest request is counted and a request
    too large for one task is ranked in segments.
    """
    by = by or ["query_id"]
    score = token_overlap("query", "document") if score is None else score
    scored = candidates.withColumn("relevance_score", rounded(score))
    if isinstance(top_n, int):
        return top_k(scored, by, [F.desc("relevance_score"), F.asc("index")], top_n)
    # ``Ordered`` sorts upwards.
    falling = scored.withColumn("__falling", -F.col("relevance_score"))
    order = ["__falling", "index"]
    if max_candidates is not None and max_candidates <= MAX_GROUP_ROWS:
        ordered = Ordered(falling, tuple(by), tuple(order), False)
    else:
        ordered = Ordered.of(falling, by, order, probe=candidates)
    ranked = ordered.position("rank").result().drop("__falling")
    ranked = ranked.withColumn("rank", (F.col("rank") + 1).cast("int"))
    if top_n is None:
        return ranked
    return ranked.filter(F.col(top_n).isNull() | (F.col("rank") <= F.col(top_n)))
