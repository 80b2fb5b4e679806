"""Shards by jump consistent hashing.

A row's shard depends on its key and the number of shards alone: a linear congruential sequence
seeded by the key gives the shards at which the row would have moved while shards were appended one
by one; the last such move within the count is its shard. There is no ring table, and appending
a shard moves rows into the new shard only.

Defined results: a null key counts as 0; null and empty text have size 8 and checksum 0; equal rows
get slots of their own in any order; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.segments import Ordered

# Fixed values of the published algorithm: the multiplier of its generator.
_MULTIPLIER = np.uint64(2862933555777941757)
ROW_OVERHEAD = 8


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: all keys jump at once, those past the end drop out."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        reach = ((at[moving] + 1) * (float(1 << 31) / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        target = reach.astype(np.int64)
        inside = target < shards
        moving = moving[inside]
        at[moving] = target[inside]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an integer key, from 0 to ``shards`` - 1."""

    @F.arrow_udf("int")
    def jump(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False), shards), pa.int32())

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (with one shard more).

    Slots run from 0 in the order of (id, size, checksum) within a shard. The rows that are ordered hold no
    text; a shard too large for one task is ordered in range partitions and numbered by their counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("key"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col(id_col), shards).alias("shard"), shard_of(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    order = ["key", "size", "text_crc32", "nth"]
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    placed = Ordered.of(rows, ["shard"], order, probe=docs.select(shard_of(F.col(id_col), shards).alias("shard")))
    return placed.position("slot").result().select(
        F.col("key").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
