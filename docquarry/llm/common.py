"""What the corpus operators share: registration, Arrow column helpers, word rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A word is a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        name = function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder)

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lowered(text: Column) -> Column:
    """Lower case for A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(texts: pa.Array) -> list[bytes]:
    """The bytes of a string column; null becomes empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the number of values in each row."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


SLICE_BYTES = 4_000_000


def text_slices(batch: pa.RecordBatch, column: int = 0):
    """Consecutive slices of a batch with about SLICE_BYTES of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)
