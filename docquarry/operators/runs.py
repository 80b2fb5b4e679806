"""Decoding of symbol sequences: best class per step, collapsed runs, text and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.segments import MAX_GROUP_ROWS, Ordered


def best_class(probabilities: DataFrame, by: list[str], cls: str = "cls", prob: str = "prob") -> DataFrame:
    """Most probable class of each step and its probability; ties go to the lower class."""
    best = F.max(F.struct(F.col(prob).alias("p"), (-F.col(cls)).alias("c")))
    return probabilities.groupBy(*by).agg(best.alias("__b")).select(
        *by, (-F.col("__b.c")).alias(cls), F.col("__b.p").alias(prob)
    )


def collapse_runs(
    steps: DataFrame, by: list[str], order: list[str], symbol: str, blank=None,
    max_group_rows: int = MAX_GROUP_ROWS, probe: DataFrame | None = None,
) -> DataFrame:
    """First row of every run of equal symbols, without the blank symbol.

    A run is broken by any other symbol, the blank included: the run test comes before the blank filter.
    """
    seen = Ordered.of(steps, by, order, max_group_rows, probe).previous(symbol, "__before").result()
    starts = seen.filter(F.col("__before").isNull() | (F.col("__before") != F.col(symbol))).drop("__before")
    return starts if blank is None else starts.filter(F.col(symbol) != F.lit(blank))


def decode_text(
    kept: DataFrame, by: list[str], order: list[str], symbol: str, piece_symbols: int,
    separator: str = "", max_group_rows: int = MAX_GROUP_ROWS, probe: DataFrame | None = None,
) -> DataFrame:
    """Kept symbols as text: ``(…, piece, n_symbols, text)``, keyed by sequence and piece.

    Piece i holds the symbols from i * ``piece_symbols`` on: the caller bounds what one row collects.
    """
    placed = Ordered.of(kept, by, order, max_group_rows, probe).position("__pos").result()
    entry = F.struct(F.col("__pos"), F.col(symbol).cast("string").alias("s"))
    return (
        placed.groupBy(*by, F.floor(F.col("__pos") / piece_symbols).cast("long").alias("piece"))
        .agg(F.array_sort(F.collect_list(entry)).alias("__s"))
        .select(*by, "piece", F.size("__s").alias("n_symbols"),
                F.array_join(F.transform("__s", lambda e: e["s"]), separator).alias("text"))
    )


def sequence_confidence(steps: DataFrame, kept: DataFrame, by: list[str], prob: str = "prob") -> DataFrame:
    """Mean probability of the kept symbols of every sequence; 0 for a sequence that kept none."""
    tagged = kept.select(*by, prob).unionByName(
        steps.select(*by).distinct().withColumn(prob, F.lit(None).cast("double"))
    )
    return tagged.groupBy(*by).agg(
        F.count(prob).alias("n_symbols"), F.coalesce(F.avg(prob), F.lit(0.0)).alias("confidence")
    )
