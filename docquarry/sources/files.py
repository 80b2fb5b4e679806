"""Raw files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.names import base_name, clean_file_name, media_type


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One UTF-8 document per file: ``(path, text)``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_manifest(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Name, size and time of every file; bytes only when asked for, so that they are not read otherwise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = base_name("path")
    columns = [
        F.col("path"),
        raw.alias("raw_name"),
        clean_file_name(raw).alias("file_name"),
        media_type(raw).alias("media_type"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"),
    ]
    if with_content:
        columns.append(F.col("content"))
    return files.select(*columns)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relational registry table; needs the database's driver jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
