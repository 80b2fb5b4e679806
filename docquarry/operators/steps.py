"""Declarative chains from a list of ``{name: parameters}``: of operators on frames, and of steps on a column's values."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.common import let
from docquarry.operators.blocks import extract_blocks, route_pages, to_markdown
from docquarry.operators.boxes import box_text, clean_boxes, insertion_order, min_score, reading_order
from docquarry.operators.chunking import chunk_fixed, chunk_recursive, chunk_report
from docquarry.operators.embedding import hash_embed
from docquarry.operators.maintenance import active_only, by_file, latest
from docquarry.operators.runs import collapse_runs, decode_text
from docquarry.operators.validate import validate_lengths, validate_users

# Only these names can be used in a chain.
STEPS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        active_only, box_text, by_file, chunk_fixed, chunk_recursive, chunk_report, clean_boxes, collapse_runs,
        decode_text, extract_blocks, hash_embed, insertion_order, latest, min_score, reading_order, route_pages, to_markdown,
        validate_lengths, validate_users,
    )
}


# Steps on a value; a step that yields nothing gives null.
VALUE_STEPS: dict[str, Callable[..., Column]] = {
    "strip_markup": lambda v: F.regexp_replace(v, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>", " "),
    "squeeze_space": lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")),
    "lower": F.lower,
    "first_chars": lambda v, n: F.substring(v, 1, n),
    "at_least": lambda v, n: F.when(F.length(v) >= n, v),
    "without": lambda v, pattern: F.when(~v.rlike(pattern), v),
    "extract": lambda v, pattern, group=0: F.nullif(F.regexp_extract(v, pattern, group), F.lit("")),
}


def _parsed(step: Mapping[str, Mapping | None], known: Mapping) -> tuple[str, Mapping]:
    if len(step) != 1:
        raise ValueError(f"a step holds exactly one operator: {step!r}")
    ((name, parameters),) = step.items()
    if name not in known:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(sorted(known))}")
    return name, parameters or {}


def run_values(df: DataFrame, steps: list[Mapping[str, Mapping | None]], column: str, output: str = "value", stopped: str = "stopped_at") -> DataFrame:
    """Send each row's value through the steps until one yields nothing.

    Adds ``output``, the last value (null for a row that stopped), and ``stopped``, the number (from 1) and name of
    the step that yielded nothing, null for a row that went through; ``0 input`` for a value that was null before. No
    later step is evaluated for a row that has stopped. Nothing is shuffled.
    """
    def advance(at: int, name: str, parameters: Mapping) -> Callable[[Column], Column]:
        def after(held: Column) -> Column:
            made = F.when(held["stopped"].isNull(), VALUE_STEPS[name](held["value"], **parameters))
            return let(made, lambda v: F.struct(
                v.alias("value"), F.coalesce(held["stopped"], F.when(v.isNull(), F.lit(f"{at} {name}"))).alias("stopped")
            ))

        return after

    state = F.struct(F.col(column).alias("value"), F.when(F.col(column).isNull(), F.lit("0 input")).alias("stopped"))
    for at, step in enumerate(steps, 1):
        state = let(state, advance(at, *_parsed(step, VALUE_STEPS)))
    kept = [c for c in df.columns if c not in (output, stopped)]
    return df.withColumn("__state", state).select(*kept, F.col("__state.value").alias(output), F.col("__state.stopped").alias(stopped))


def run_steps(df: DataFrame, steps: list[Mapping[str, Mapping | None]]) -> DataFrame:
    """Apply the named operators in order; each entry holds exactly one name."""
    for step in steps:
        name, parameters = _parsed(step, STEPS)
        df = df.transform(STEPS[name], **parameters)
    return df
