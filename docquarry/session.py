"""Session settings, shared folders and size checks used all over the package."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and found below both bounds.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 32 * 1024 * 1024


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: UDFs refer to its modules."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="docquarry-"), "docquarry"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def build_session(app_name: str = "docquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder stands in, but only in single-machine mode: on a cluster a
    machine-local folder would lose data with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="docquarry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_scratch: list[tuple[str, str | None]] = []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder, kept until ``release_scratch``."""
    path = f"{shared_root(spark)}/docquarry/{purpose}-{uuid.uuid4().hex}"
    _scratch.append((spark.sparkContext.applicationId, path))
    return path


def scratch_mark() -> int:
    """How many scratch paths there are; paths made later can be released by this mark."""
    return len(_scratch)


def release_scratch(spark: SparkSession, mark: int = 0, stop: int | None = None) -> None:
    """Delete the scratch paths made since ``mark``, when all that was derived from them has been written elsewhere.

    With ``stop``, a later mark, paths made from there on are kept.
    """
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i, (application, path) in enumerate(_scratch[mark:stop], mark):
        if path and application == spark.sparkContext.applicationId:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(configuration).delete(target, True)
        # Later marks count from the start of the list: a place in it stays.
        _scratch[i] = (application, None)
    if stop is None:
        del _scratch[mark:]


def has_files(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


# Shuffle files of a write go as soon as it is done; otherwise they stay until the driver collects its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def writing(spark: SparkSession, open_folders: int | None = None) -> Iterator[None]:
    """Settings of a write: its shuffle files are deleted after it, and a task keeps files of so many folders open at a time."""
    wanted = {_CLEAN_UP: "true"} | ({} if open_folders is None else {OPEN_FILES: str(open_folders)})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(
    df: DataFrame, purpose: str, release_since: int | None = None, compression: str | None = None, block_bytes: int | None = None,
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    With ``release_since`` (a ``scratch_mark``) the scratch paths made from there on, from which ``df`` was
    derived, are deleted once it is written. ``compression`` names another codec than the session's, ``block_bytes`` the size
    of a row group before compression: a task reads one at least, however large the file is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    options = {} if block_bytes is None else {"parquet.block.size": str(block_bytes)}
    with writing(spark):
        df.write.options(**options).parquet(path, compression=compression)
    if release_since is not None:
        own = _scratch.pop()
        release_scratch(spark, release_since)
        _scratch.append(own)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, by partial sums in every task."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Broadcast hint on ``df`` when the measured side is small; else ``df`` unchanged (shuffle join).

    ``probe`` is a cheaper frame with at least as many rows as ``df``, when there is one.
    """
    return F.broadcast(df) if fits_broadcast(df if probe is None else probe) else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a source that has fewer splits than the cluster has cores, else leave it alone.

    For CPU-heavy work on a small file. A large table has more splits than cores and is not shuffled.
    Only for frames that are plain scans: counting the partitions of a shuffled frame would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
