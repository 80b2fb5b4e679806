"""Incremental ingest: the batch functions applied to files as they arrive.

Repeats: with a time column and a delay Spark keeps the keys in state behind a watermark, of a size that the delay
bounds; rows that come later than that go to a side output and are merged when the result is read, so nothing is
lost. Without a delay there is no state, and every batch is compared with all that is stored. Window counts need no
state: the counts of the batches add up, and no batch reads what earlier ones stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, **options: str) -> DataFrame:
    """Stream over the parquet file or folder ``<folder>/<name>.parquet``."""
    target = f"{folder.rstrip('/')}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    is_folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.parquet(target) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def ingest_stream(
    source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
) -> StreamingQuery:
    """Append the transformed rows of each micro-batch to ``path``.

    Each batch owns a folder that a retry overwrites, so a batch that is run again after a failure
    does not add its rows twice. Stops when all present input is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def dedup_stream(
    source: DataFrame, key: list[str], path: str, checkpoint: str, columns: list[str],
    time_col: str | None = None, delay: str | None = None,
) -> StreamingQuery:
    """Append one row per key to ``path``.

    With ``time_col`` and ``delay`` keys are held in Spark's state until the watermark has passed them; rows behind the
    watermark are stored aside, and ``read_first`` adds those whose key is new. Without them a batch is reduced to one
    row per key and joined against the keys that all other batches stored.
    """
    if delay is not None:
        return _dedup_with_state(source, key, path, checkpoint, columns, time_col, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(key)
        stored = _stored(batch.sparkSession, path, batch_id)
        if stored is not None:
            fresh = fresh.join(stored.select(*key), key, "left_anti")
        fresh.select(*columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _dedup_with_state(source, key, path, checkpoint, columns, time_col, delay) -> StreamingQuery:
    timed = source.withWatermark(time_col, delay)
    moment = F.col(time_col).alias("__time")
    first = timed.dropDuplicatesWithinWatermark(key).select(*columns, moment, F.lit(False).alias("late"))
    every = timed.select(*columns, moment, F.lit(True).alias("late"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The rows that Spark may have dropped are those behind the newest watermark there can be: the latest time of
        # earlier batches less the delay. It is kept beside the rows, one value per batch.
        before = _latest_time(spark, path, batch_id)
        behind = F.lit(False) if before is None else F.col("__time") <= F.timestamp_micros(F.lit(before)) - F.expr(f"INTERVAL {delay}")
        seen = Observation()
        watched = batch.observe(seen, F.max(F.unix_micros("__time")).alias("latest"))
        kept = watched.filter(~F.col("late") | behind).drop("__time")
        kept.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch_id={batch_id}")
        latest = max((t for t in (before, seen.get["latest"]) if t is not None), default=None)
        clock = spark.createDataFrame([(latest,)], "latest long").coalesce(1)
        clock.write.mode("overwrite").parquet(f"{path}.clock/{batch_id}")

    both = first.unionByName(every)
    return both.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest_time(spark: SparkSession, path: str, batch_id: int) -> int | None:
    return spark.read.schema("latest long").parquet(f"{path}.clock/{batch_id - 1}").first()[0] if batch_id else None


def read_first(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """What ``dedup_stream`` with a delay stored: the rows in time, and of every late key without one a single row."""
    rows = spark.read.parquet(path).withColumn("late", F.col("late").cast("boolean"))
    first = rows.filter(~F.col("late"))
    late = rows.filter("late").dropDuplicates(key).join(first.select(*key), key, "left_anti")
    return first.unionByName(late).drop("late", "batch_id")


def _stored(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the other batches wrote; none before the first. A batch that is run again does not see its own rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    others = [s for s in (files.listStatus(target) if files.exists(target) else []) if s.getPath().getName() != f"batch_id={batch_id}"]
    if not [s for s in others if s.getPath().getName().startswith("batch_id=")]:
        return None
    return spark.read.parquet(path).filter(F.col("batch_id") != batch_id)


def windowed_counts(batch: DataFrame, time_col: str, by: list[str], width: str = "1 hour") -> DataFrame:
    """Rows per time window and group."""
    counts = batch.groupBy(F.window(time_col, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n")


def count_stream(
    source: DataFrame, time_col: str, by: list[str], path: str, checkpoint: str, width: str = "1 hour"
) -> StreamingQuery:
    """Store the window counts of each batch; ``read_counts`` adds them up, so late rows count like others."""
    return ingest_stream(source, lambda batch: windowed_counts(batch, time_col, by, width), path, checkpoint)


def read_counts(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Counts over all batches so far."""
    return spark.read.parquet(path).groupBy(*key).agg(F.sum("n").alias("n"))
