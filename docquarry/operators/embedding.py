"""Text to vector, by a plug-in encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import list_slices, query_prompt, tokenize
from docquarry.functions.vectors import cut_dimensions

# An encoder factory is called once per task and returns a function from texts to a matrix.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def embed(
    df: DataFrame, encoder: EncoderFactory, text_col: str = "content", output: str = "embedding",
    instruction: str | None = None, dimensions: int | None = None,
) -> DataFrame:
    """Adds unit vectors. The encoder is built once per task and fed Arrow batches of texts."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            matrix = np.asarray(model(batch.fillna("").tolist()), dtype=np.float64)
            yield pd.Series(list(_unit_rows(matrix).astype(np.float32)), index=batch.index)

    text = F.col(text_col) if instruction is None else query_prompt(text_col, F.lit(instruction))
    return df.withColumn(output, cut_dimensions(encode(text), dimensions))


# Buckets of tokens that a task remembers at a time.
KNOWN_TOKENS = 200_000


def _bucket_counts(tokens: pa.Array, dimensions: int, normalize: bool, known: dict[str, int]) -> np.ndarray:
    """Tokens of each list counted by bucket, the first 32 bits of their md5; ``known`` has the buckets of tokens met before."""
    n = len(tokens)
    sizes = np.asarray(pc.fill_null(tokens.value_lengths(), 0))
    named = tokens.flatten().dictionary_encode()
    buckets = np.empty(len(named.dictionary), dtype=np.int64)
    for i, token in enumerate(named.dictionary.to_pylist()):
        bucket = known.get(token)
        if bucket is None:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            bucket = int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4], "big") % dimensions
            known[token] = bucket
        buckets[i] = bucket
    rows = np.repeat(np.arange(n), sizes)
    dense = np.bincount(rows * dimensions + buckets[np.asarray(named.indices)], minlength=n * dimensions)
    dense = dense.astype(np.float64).reshape(n, dimensions)
    return _unit_rows(dense) if normalize else dense


def token_counter(dimensions: int, normalize: bool = True):
    """UDF from token lists to a dense vector of counts by bucket; a null list counts nothing."""

    @F.arrow_udf("array<double>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            parts = [_bucket_counts(batch[part], dimensions, normalize, known).ravel() for part in list_slices(batch)]
            offsets = np.arange(0, (len(batch) + 1) * dimensions, dimensions, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0), *parts])))

    return count


def hash_embed(
    df: DataFrame, text_col: str = "content", output: str = "embedding",
    dimensions: int = 64, normalize: bool = True,
) -> DataFrame:
    """Feature hashing: token counts per bucket, unit length.

    The built-in encoder: deterministic and without a model, so not a semantic embedding.
    """
    vector = token_counter(dimensions, normalize)(tokenize(text_col))
    return df.withColumn(output, vector)
