"""Chunk tables in Spark's catalog: partitions are made, listed and dropped by DDL, without listing or reading files.

Names are SQL identifiers, quoted by the caller where they need it. Partition values are passed as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.schemas import CHUNK
from docquarry.sources.chunks import PARTITIONS, _conform


def create_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """An empty chunk table partitioned by collection and partition name, unless there is one."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK.fields)
    place = f"LOCATION {_literal(location)}" if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({', '.join(PARTITIONS)}) {place}"
    )


def insert_chunks(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """Add rows; with ``overwrite`` they replace the partitions that occur in ``df`` and no other.

    The catalog learns new partitions from the write itself.
    """
    columns = [*[f.name for f in CHUNK.fields if f.name not in PARTITIONS], *PARTITIONS]
    rows = _conform(df).select(*columns).hint("rebalance", *PARTITIONS)
    rows.write.insertInto(name, overwrite=overwrite)


def list_partitions(spark: SparkSession, name: str, collection: str | None = None) -> DataFrame:
    """``(collection, partition_name)`` of all partitions, or those of one collection, from the catalog alone."""
    only = f" PARTITION (collection = {_literal(collection)})" if collection is not None else ""
    shown = spark.sql(f"SHOW PARTITIONS {name}{only}").select(F.split("partition", "/").alias("parts"))
    # Shown as folder names, special characters as % and two hexadecimal digits; a plus sign stands for itself.
    value = lambda i: F.url_decode(F.replace(F.regexp_replace(F.get("parts", F.lit(i)), "^[^=]*=", ""), F.lit("+"), F.lit("%2B")))
    return shown.select(value(0).alias("collection"), value(1).alias("partition_name"))


def drop_partitions(spark: SparkSession, name: str, collection: str, partition_name: str | None = None) -> int:
    """Drop a collection, or one partition of it, in one statement; returns how many partitions went."""
    found = [r.partition_name for r in list_partitions(spark, name, collection).collect()]
    gone = [p for p in found if partition_name in (None, p)]
    if gone:
        specs = ", ".join(f"PARTITION (collection = {_literal(collection)}, partition_name = {_literal(p)})" for p in gone)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
    return len(gone)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
