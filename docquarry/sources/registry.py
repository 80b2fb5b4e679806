"""Registry tables (user, knowledge, file) as parquet under one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.maintenance import insert_if_absent
from docquarry.schemas import REGISTRY


def table_path(root: str, name: str) -> str:
    if name not in REGISTRY:
        raise ValueError(f"unknown registry table {name!r}")
    return f"{root.rstrip('/')}/{name}"


def init_registry(spark: SparkSession, root: str, mode: str = "ignore", default_user: str | None = None) -> None:
    """Create the tables; ``overwrite`` drops what is there, ``ignore`` keeps it."""
    if mode not in ("ignore", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    for name, schema in REGISTRY.items():
        spark.createDataFrame([], schema).write.mode(mode).parquet(table_path(root, name))
    if default_user:
        row = spark.createDataFrame([(1, default_user, 1)], "user_id long, user_name string, user_status int")
        add_absent(row, root, "user", ["user_id"])


def read_registry(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(REGISTRY[name]).parquet(table_path(root, name))


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Columns in table order and type; audit times are set when absent."""
    for column in ("create_time", "update_time"):
        if column not in df.columns:
            df = df.withColumn(column, F.current_timestamp())
    return df.select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY[name].fields])


def append_registry(df: DataFrame, root: str, name: str) -> None:
    _typed(df, name).write.mode("append").parquet(table_path(root, name))


def add_absent(df: DataFrame, root: str, name: str, key: list[str]) -> int:
    """Append the rows whose key is not in the table; returns how many.

    A knowledge base is keyed by (user_id, partition_name): two users may use the same name.
    """
    typed = _typed(df, name)
    existing = read_registry(df.sparkSession, root, name)
    version = [c for c in typed.columns if c not in (*key, "create_time", "update_time")] or key
    fresh = insert_if_absent(existing, typed, key, version)
    added = Observation()
    fresh.observe(added, F.count("*").alias("n")).write.mode("append").parquet(table_path(root, name))
    return added.get["n"]
