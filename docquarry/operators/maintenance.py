"""Upsert, delete, insert-if-absent and other whole-table maintenance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.common import top_k
from docquarry.session import broadcast_if_small


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Row with the highest version per key; ``version`` must order the rows of a key completely.

    Each map task keeps one row per key before the shuffle, so a key with many versions is no hot spot.
    """
    window = Window.partitionBy(*key).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Incoming rows replace existing rows of the same key; repeats inside the batch resolve to the latest.

    Existing keys are taken to be unique. The existing side is not shuffled while the keys of the batch are
    counted and found small.
    """
    keys = incoming.select(*key).distinct()
    return existing.join(broadcast_if_small(keys), key, "left_anti").unionByName(latest(incoming, key, version))


def upsert_report(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows sent, distinct keys sent, of these inserted and updated."""
    sent = incoming.groupBy(*key).agg(F.count("*").alias("n"))
    known = existing.select(*key, F.lit(1).alias("known")).distinct()
    return sent.join(known, key, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sent"),
        F.count("*").alias("written"),
        F.count("known").alias("updated"),
        (F.count("*") - F.count("known")).alias("inserted"),
    )


def delete_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; ids that are not in the table do no harm."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """New rows whose key is unknown; of repeats among them the first by ``version``."""
    unknown = new.join(existing.select(*key), key, "left_anti")
    window = Window.partitionBy(*key).orderBy(*[F.asc(v) for v in version])
    return unknown.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def present(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(keys.select(*key).distinct(), key, "left_semi")


def by_file(
    chunks: DataFrame, files: DataFrame | list, column: str = "file_id", page: int | None = None, order: str = "chunk_id"
) -> DataFrame:
    """Exact lookup: the rows of all listed files. A ``page`` keeps the first rows of each file in key order."""
    if isinstance(files, DataFrame):
        found = chunks.join(files.select(column).distinct(), column, "left_semi")
    else:
        found = chunks.filter(F.col(column).isin(files))
    return found if page is None else top_k(found, [column], [F.asc(order)], page).drop("rank")


def active_only(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 1)


def list_indexes(rows: DataFrame, collection: str, partition: str, file_id: str, content: str) -> DataFrame:
    """Rows, files and characters of every collection and partition."""
    return rows.groupBy(collection, partition).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(file_id).alias("n_files"),
        F.sum(F.length(content)).cast("long").alias("n_chars"),
    )


def has_index(rows: DataFrame, collection: str, name: str) -> bool:
    return not rows.filter(F.lower(F.col(collection)) == name.lower()).limit(1).isEmpty()


def enrich_chunks(chunks: DataFrame, files: DataFrame, knowledge: DataFrame, users: DataFrame) -> DataFrame:
    """File, knowledge base and user columns beside every chunk.

    No hints: Spark broadcasts a registry table where its size allows and otherwise joins by
    shuffle, splitting skewed keys.
    """
    return (
        chunks.join(files, "file_id", "left").join(knowledge, "knowledge_id", "left").join(users, "user_id", "left")
    )


# Rows of one side in a task of the joins below; a task sorts three sides.
TASK_ROWS = 500_000


def align_uploads(names: DataFrame, urls: DataFrame, paths: DataFrame, key: str = "file_key") -> tuple[DataFrame, DataFrame]:
    """Names, URLs and paths by key: complete rows, and names whose upload failed.

    A task of a sort-merge join holds its part of all three sides. Where the session's partitions would be larger than
    ``TASK_ROWS`` rows of the largest side, the sides are dealt to more of them: memory does not follow the table.
    """
    sides = [names, urls, paths]
    parts = math.ceil(max(side.count() for side in sides) / TASK_ROWS)
    if parts > int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        sides = [side.repartition(parts, key) for side in sides]
    names, urls, paths = sides
    joined = names.join(urls, key, "left").join(paths, key, "left")
    done = F.col("file_url").isNotNull() & F.col("file_path").isNotNull()
    return joined.filter(done), joined.filter(~done)
