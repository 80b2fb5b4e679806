"""Token counts of documents in flat token files that have no index.

A flat token file is nothing but ids of fixed width, each document closed by the end-of-document id.
It is kept and read in blocks of fixed size, and documents begin and end anywhere in them. Every block
is searched for the separator in one vectorised comparison. A prefix scan over the blocks' summaries
(tokens, separators, place of the last separator) then gives each block the place where it
begins, the number of documents before it, and the length of the document that reaches into it, so
that documents are stitched across block borders without reading a block twice.

Defined results: empty documents (a separator right after another) count 0 tokens; tokens after the
last separator of a file are a document of their own, not closed; an empty file has no documents; null
blocks count as empty; null texts are written as empty documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.bpe import encoder
from docquarry.llm.common import lists
from docquarry.operators.segments import Ordered
from docquarry.session import materialise, scratch_path

BLOCK_TOKENS = 1 << 16
WIDTH = "<u2"


def write_flat(
    docs: DataFrame, tokenizer: str, eod: int, path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode the texts and write flat token files as blocks: (file, block, data, ended).

    One file per task, in the order of the rows. ``ended`` lists the ids of the documents that end in the block; the
    scan does not use it.
    """

    def pack(batches):
        file, block = TaskContext.get().partitionId(), 0
        held, ended = np.zeros(0, WIDTH), []  # not yet written: tokens, and (end among them, document)

        def cut(size: int):
            nonlocal held, ended, block
            here = [d for end, d in ended if end < size]
            row = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([held[:size].tobytes()], pa.binary()),
                 pa.array([here], pa.list_(pa.int64()))], ["file", "block", "data", "ended"],
            )
            held, ended, block = held[size:], [(end - size, d) for end, d in ended if end >= size], block + 1
            return row

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, sizes = encoder(tokenizer, False).encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(np.array(sizes) + 1) - 1  # places of the separators among the new tokens
                stream = np.empty(len(ids) + len(sizes), WIDTH)
                closing = np.zeros(len(stream), bool)
                closing[ends] = True
                stream[closing], stream[~closing] = eod, ids
                ended += list(zip((ends + len(held)).tolist(), part.column(0).to_pylist()))
                held = np.concatenate([held, stream])
                while len(held) >= block_tokens:
                    yield cut(block_tokens)
        if len(held):
            yield cut(len(held))

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    packed = rows.mapInArrow(pack, "file int, block bigint, data binary, ended array<bigint>")
    packed.write.option("compression", "zstd").parquet(path)


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files as other tools write them: raw ids, each file below 2 GB (one row of Spark's reader)."""
    width = block_tokens * np.dtype(WIDTH).itemsize
    whole = spark.read.format("binaryFile").load(path)
    count = F.ceil(F.col("length") / width)
    spread = whole.filter("length > 0").select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    return spread.select(
        F.col("path").alias("file"), F.col("block").cast("bigint"), F.substring("content", (F.col("block") * width + 1).cast("int"), F.lit(width)).alias("data")
    )


@F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType(), False))]))
def _separators(blocks: pa.Array, eods: pa.Array) -> pa.Array:
    eod = eods[0].as_py() if len(eods) else 0
    counts, ends = [], [np.zeros(0, np.int64)]
    for block in blocks.to_pylist():
        ids = np.frombuffer(block or b"", WIDTH)
        counts.append(len(ids))
        ends.append(np.flatnonzero(ids == eod))
    found = lists(np.concatenate(ends), [len(e) for e in ends[1:]], pa.int64())
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), found], ["tokens", "ends"])


def separator_scan(blocks: DataFrame, eod: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents of flat files: file, ordinal in the file, start, ``n_tokens`` (without separator), ``closed``.

    ``blocks`` has file, block, data; ``keep`` names further columns, lists with one value per document that ends
    in the block, which are spread over the documents.
    """
    found = blocks.select("file", "block", *keep, _separators("data", F.lit(eod)).alias("s"))
    summary = materialise(found.select(
        "file", "block", *keep, F.col("s.tokens").alias("tokens"), F.col("s.ends").alias("ends"),
        F.size("s.ends").cast("long").alias("closings"),
    ), "block-summaries")
    placed = Ordered.of(summary, ["file"], ["block"]).running_sum("tokens", "through").running_sum("closings", "closed")
    placed = materialise(placed.result().select(
        "file", "block", *keep, "ends", (F.col("through") - F.col("tokens")).alias("begins"), (F.col("closed") - F.col("closings")).alias("before"),
        (F.col("through") - F.col("tokens") + F.get("ends", F.size("ends") - 1)).alias("last"),
    ), "block-places")
    closing = placed.filter("size(ends) > 0")
    carried = Ordered.of(closing, ["file"], ["block"]).previous("last", "last_before").result()
    starts = F.transform(
        "ends", lambda e, i: F.when(i == 0, F.coalesce(F.col("last_before"), F.lit(-1).cast("long")) + 1).otherwise(F.col("begins") + F.get("ends", i - 1) + 1)
    )
    each = carried.select("file", "before", "begins", F.posexplode(F.arrays_zip("ends", starts.alias("starts"), *keep)).alias("at", "d"))
    closed = each.select(
        "file", (F.col("before") + F.col("at")).alias("ordinal"), F.col("d.starts").alias("start"),
        (F.col("begins") + F.col("d.ends") - F.col("d.starts")).alias("n_tokens"), F.lit(True).alias("closed"), *[F.col("d")[k].alias(k) for k in keep],
    )
    files = summary.groupBy("file").agg(F.sum("tokens").alias("all"), F.sum("closings").alias("ordinal"))
    lasts = placed.groupBy("file").agg(F.coalesce(F.max("last"), F.lit(-1).cast("long")).alias("last"))
    rest = files.join(lasts, "file").filter(F.col("all") > F.col("last") + 1)
    empty = [F.lit(None).cast(blocks.schema[k].dataType.elementType).alias(k) for k in keep]
    return closed.union(rest.select(
        "file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("all") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"), *empty
    ))


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as flat token files in the shared folder and count them again by scanning the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat-tokens")
    write_flat(docs, tokenizer, eod, path, id_col, text_col)
    counts = separator_scan(spark.read.parquet(path), eod, keep=("ended",))
    return counts.select(F.col("ended").alias(id_col), "file", "ordinal", "start", "n_tokens", "closed")
