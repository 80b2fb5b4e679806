"""Helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are rounded before ranking, so that equal texts tie exactly and the id decides,
# whatever the order in which partial sums were added.
SCORE_DIGITS = 9


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, ranked from 1.

    Spark keeps only ``k`` rows per group in each map task (``WindowGroupLimit``), so a hot group
    is cut down before the shuffle. ``k`` is expected to be small (a result page).
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
