"""Inverted index, BM25 search, fuzzy term expansion, merging of hits."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docquarry.functions.text import counted_terms, list_slices, term_counts, tokenize
from docquarry.operators.common import SCORE_DIGITS, rounded, top_k
from docquarry.operators.knn import merge_pairs
from docquarry.params import LEXICAL_TOP_K, Bm25Params, read_params, write_params
from docquarry.session import (
    OPEN_FILES, broadcast_if_small, fits_broadcast, has_files, materialise, release_scratch, scratch_mark, spread, writing,
)


# A search that scans documents broadcasts a weight per query and term. More weights are scanned for in several groups
# of queries; what needs still more groups is joined, which shuffles a row per query and posting.
SCAN_MAX_WEIGHTS = 2_000_000
SCAN_MAX_GROUPS = 8
# Products of weight and gain in one block of a scan task, and terms of documents looked up at a time.
_BLOCK_VALUES = 500_000
_SLICE_TERMS = 500_000


@dataclass(frozen=True)
class TextIndex:
    """``postings`` (id, dl, term, tf), ``terms`` (term, df), ``collection`` (n_docs, avg_dl; one row).

    ``forward`` (id, dl, counts) has a document's terms in one row. Of a ``stored`` index the
    tables are read from files, otherwise they are computed from the documents when used, and ``tokens``
    (id, tokens) has what a scan looks up itself instead of counting all terms first. Columns that were kept
    beside the id (collection, partition, file) are in ``postings``, ``forward`` and ``tokens``, and a search can be
    restricted by them.
    """

    postings: DataFrame
    terms: DataFrame
    collection: DataFrame
    id_col: str
    params: Bm25Params = Bm25Params()
    forward: DataFrame | None = None
    tokens: DataFrame | None = None
    stored: bool = False
    # Of a stored index: postings joined with a table of terms before their documents are looked up.
    matching: Callable[[DataFrame], DataFrame] | None = None


def _tokens(text_col: str, params: Bm25Params):
    return tokenize(text_col, params.han_bigrams)


def forward_rows(
    docs: DataFrame, id_col: str, text_col: str, params: Bm25Params = Bm25Params(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document with its length and term counts. Needs no shuffle: counts are taken inside the row."""
    tokens = docs.select(id_col, *keep, _tokens(text_col, params).alias("tokens"))
    counts = F.when(F.col("tokens").isNotNull(), counted_terms()(F.col("tokens")))
    return tokens.select(id_col, *keep, F.size("tokens").alias("dl"), counts.alias("counts"))


def postings(
    docs: DataFrame, id_col: str, text_col: str, params: Bm25Params = Bm25Params(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document and term, without a shuffle."""
    tokens = docs.select(id_col, *keep, _tokens(text_col, params).alias("tokens"))
    return tokens.select(id_col, *keep, F.size("tokens").alias("dl"), F.inline(term_counts(F.col("tokens"))))


def index_of(
    docs: DataFrame, id_col: str, text_col: str, params: Bm25Params = Bm25Params(), keep: tuple[str, ...] = ()
) -> TextIndex:
    """Index computed on the fly, for one search over a table that has no stored index."""
    posted = postings(docs, id_col, text_col, params, keep)
    return TextIndex(
        postings=posted,
        terms=posted.groupBy("term").agg(F.count("*").alias("df")),
        collection=corpus_stats(docs, text_col, params),
        id_col=id_col,
        params=params,
        forward=forward_rows(docs, id_col, text_col, params, keep),
        tokens=docs.select(id_col, *keep, _tokens(text_col, params).alias("tokens")),
    )


def corpus_stats(docs: DataFrame, text_col: str, params: Bm25Params = Bm25Params()) -> DataFrame:
    """Number of documents that have a term, and their mean length in terms."""
    # A filter on the length would tokenise twice: empty documents become null instead.
    length = F.nullif(F.size(_tokens(text_col, params)), F.lit(0))
    return docs.select(length.alias("dl")).agg(F.count("dl").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def restrict(index: TextIndex, where: Column) -> TextIndex:
    """The index of the documents that satisfy ``where``: counts and lengths are those of these documents alone."""
    forward, posted = index.forward.filter(where), index.postings.filter(where)
    length = F.nullif("dl", F.lit(0))
    terms = forward.select(F.explode("counts.term").alias("term"))
    return replace(
        index, forward=forward, tokens=None if index.tokens is None else index.tokens.filter(where), postings=posted, terms=terms.groupBy("term").agg(F.count("*").alias("df")),
        collection=forward.agg(F.count(length).alias("n_docs"), F.avg(length).alias("avg_dl")), stored=False, matching=None,
    )


# --- the stored index ------------------------------------------------------------------------
#
# Plain tables, all partitioned by the columns the caller names and by a bucket: forward (a document's number and its terms
# in one row), postings (a row per document and term, with the document's number in place of its id and kept columns),
# terms (df) and sizes (documents and their length). A bucket is the part of the documents of one write that a hash of the
# id gives: bucket ``b`` holds part ``b % buckets`` of write ``b // buckets``, and numbers are unique in a write. New rows
# go into partitions of their own; rows that are replaced or removed are left out of theirs, which are copied by dynamic
# overwrite without a shuffle. forward is written last and is what changes start from: a change that broke off is made
# whole by repeating it. Every copied partition holds a row without id or term, so that one that has lost all its rows is
# overwritten too; such rows are left out when the index is opened. After ``MAX_WRITES`` writes all rows are put together.

BUCKETS = 8
MAX_WRITES = 16
# A write task keeps the files of so many folders open at a time and sorts its rows by folder only where it has more: a sort
# that begins with the folders compares equal strings for every pair of rows.
OPEN_FOLDERS = 16
_OPEN_FILES = OPEN_FILES
# Terms come before postings: the shuffle files of their count are gone when the larger table is written.
_TABLES = ("terms", "postings", "sizes", "forward")
# Postings are sorted: numbers rise by little inside a term and are stored as differences, as terms are to those before them.
_CODEC = "zstd"
# Documents that wait to be indexed are read in pieces whose postings a task can sort in memory.
_BLOCK_BYTES = 16 * 1024 * 1024
_POSTINGS_OPTIONS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#doc": "false", "parquet.enable.dictionary#term": "false"}


@dataclass(frozen=True)
class _Layout:
    """How an index is stored: schema of ``forward`` (without number and bucket), partition columns, buckets of a write."""

    schema: StructType
    partition_by: tuple[str, ...]
    buckets: int

    @property
    def folders(self) -> list[str]:
        return [*self.partition_by, "bucket"]

    def bucketed(self, rows: DataFrame, id_col: str, write: int = 0) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int") + F.lit(write * self.buckets))

    def first_bucket(self) -> Column:
        """The first bucket of the same write: terms are counted by write, not by bucket, as most are in every bucket."""
        return (F.col("bucket") - F.pmod(F.col("bucket"), F.lit(self.buckets))).cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.schema.json(), list(self.partition_by), self.buckets)
        kept = spark.createDataFrame([row], "schema string, partition_by array<string>, buckets int")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")

    @staticmethod
    def load(spark: SparkSession, path: str) -> _Layout:
        row = spark.read.parquet(f"{path}/layout").first()
        return _Layout(StructType.fromJson(json.loads(row.schema)), tuple(row.partition_by), row.buckets)


def _stored(spark: SparkSession, path: str, layout: _Layout, table: str) -> DataFrame:
    """A table of the index with declared types; partition columns keep theirs whatever the folders are called."""
    fields = {f.name: f for f in [*layout.schema.fields, StructField("bucket", IntegerType())]}
    own = {
        "forward": [*layout.schema.fieldNames(), "doc"],
        "postings": [*layout.partition_by, "doc", "term", "tf"],
        "terms": [*layout.partition_by, "term", "df"],
        "sizes": [*layout.partition_by, "n_docs", "n_terms"],
    }[table]
    added = {"doc": LongType(), "term": StringType(), "tf": IntegerType(), "df": LongType(), "n_docs": LongType(), "n_terms": LongType()}
    schema = StructType([fields.get(c) or StructField(c, added[c]) for c in [*own, "bucket"]])
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of one write with a number each, in the order they are read."""
    return rows.withColumn("doc", F.monotonically_increasing_id())


def _posted(layout: _Layout, rows: DataFrame) -> DataFrame:
    return rows.select(*layout.folders, "doc", F.inline("counts"))


def _term_counts(layout: _Layout, rows: DataFrame) -> DataFrame:
    terms = rows.select(*layout.partition_by, layout.first_bucket().alias("bucket"), F.explode("counts.term").alias("term"))
    return terms.groupBy(*layout.folders, "term").agg(F.count("*").alias("df"))


def _sizes(layout: _Layout, rows: DataFrame) -> DataFrame:
    length = F.nullif("dl", F.lit(0))
    return rows.groupBy(*layout.folders).agg(F.count(length).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_terms"))


def _write_table(path: str, table: str, layout: _Layout, rows: DataFrame, blank: DataFrame | None, balance: bool) -> None:
    """Write a table, or with ``blank`` (a row for every partition that is copied) the partitions that ``rows`` and ``blank`` have."""
    # Rebalancing splits a hot partition over several write tasks and puts small ones together.
    rows = rows.hint("rebalance", *layout.folders) if balance else rows
    if blank is not None:
        rows = rows.unionByName(blank, allowMissingColumns=True)
    options = {}
    if table == "postings":
        # Sorted by term, a search reads only the row groups of its terms. What is copied is in order but for the seams of files.
        rows, options = rows.sortWithinPartitions("term", "doc"), _POSTINGS_OPTIONS
    elif table == "terms":
        rows = rows.sortWithinPartitions("term")
    writer = rows.write.mode("overwrite").partitionBy(*layout.folders).options(**options)
    if blank is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    with writing(rows.sparkSession, OPEN_FOLDERS):
        writer.parquet(f"{path}/{table}", compression=_CODEC)


def _same_rows(held: DataFrame, fresh: DataFrame, id_col: str) -> DataFrame:
    """Ids whose rows the index holds just as they are sent."""
    columns = [c for c in fresh.columns if c != id_col]

    def prints(rows: DataFrame, name: str) -> DataFrame:
        # Nulls do not enter a hash: it is told which columns have them.
        row = F.xxhash64(*columns, *[F.isnull(c) for c in columns])
        return rows.select(id_col, row.alias("row")).groupBy(id_col).agg(F.sort_array(F.collect_list("row")).alias(name))

    both = prints(fresh, "sent").join(prints(held, "kept"), id_col)
    return both.filter("sent = kept").select(id_col)


def _marks(layout: _Layout, rows: DataFrame) -> DataFrame:
    """Stored forward rows as a bit each, in bitmaps by write and stretch of numbers."""
    write, nth = layout.first_bucket().alias("write"), F.col("doc") + 1
    places = rows.select(write, F.bitmap_bucket_number(nth).alias("stretch"), F.bitmap_bit_position(nth).alias("bit"))
    return places.groupBy("write", "stretch").agg(F.bitmap_construct_agg("bit").alias("marks"))


def _unlisted(layout: _Layout, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of documents that are not among the forward rows ``gone``, of which there are few."""
    lost = gone.select(layout.first_bucket().alias("write"), F.col("doc").alias("lost"))
    return rows.join(F.broadcast(lost), (layout.first_bucket() == F.col("write")) & (F.col("doc") == F.col("lost")), "left_anti")


def _unmarked(layout: _Layout, rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with a number that is not marked. However many are, a bit each is sent to the tasks and no row is shuffled."""
    nth = F.col("doc") + 1
    place = F.bitmap_bit_position(nth)
    byte = F.substring("marks", (place / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int"))
    on = [layout.first_bucket() == F.col("write"), F.bitmap_bucket_number(nth) == F.col("stretch"), bit == 1]
    return rows.join(broadcast_if_small(marks), reduce(lambda x, y: x & y, on), "left_anti")


def _change(spark: SparkSession, path: str, id_col: str, fresh: DataFrame | None, dead: DataFrame | None, balance: bool = True) -> None:
    """Put ``fresh`` (forward rows with numbers, stored) in place of what the index holds of their ids, and remove the ids in ``dead``."""
    mark, layout = scratch_mark(), _Layout.load(spark, path)
    stored = _stored(spark, path, layout, "forward")
    held = stored.filter(F.col(id_col).isNotNull())
    parts = [f.select(id_col) for f in (fresh, dead) if f is not None]
    ids = materialise(reduce(DataFrame.union, parts).distinct(), "changed-ids")
    gone = materialise(held.join(broadcast_if_small(ids), id_col, "left_semi").select(id_col, *layout.folders, "doc"), "replaced-rows")
    if fresh is not None and not gone.isEmpty():
        # A document that is sent again as it is held is no change.
        same = materialise(_same_rows(held.select(*layout.schema.fieldNames()), fresh.drop("doc"), id_col), "same-rows")
        if dead is not None:
            same = same.join(dead.select(id_col), id_col, "left_anti")
        fresh, gone = (rows.join(broadcast_if_small(same), id_col, "left_anti") for rows in (fresh, gone))
    last = held.agg(F.max("bucket")).first()[0]
    write = 0 if last is None else last // layout.buckets + 1
    if gone.isEmpty() and (fresh is None or fresh.isEmpty()):
        release_scratch(spark, mark)
        return
    gone = materialise(gone.select(*layout.folders, "doc"), "lost-rows")
    if fits_broadcast(gone):
        left = lambda rows: _unlisted(layout, rows, gone)
    else:
        marks = materialise(_marks(layout, gone), "replaced-marks")
        left = lambda rows: _unmarked(layout, rows, marks)
    if write >= MAX_WRITES:
        # All rows anew, as one write: every partition there is gets copied without rows or with new ones.
        kept = left(held).select(*layout.schema.fieldNames())
        rows = kept if fresh is None else kept.unionByName(fresh.select(*kept.columns))
        fresh = materialise(_numbered(rows), "index-rows", compression=_CODEC, block_bytes=_BLOCK_BYTES)
        write, touched, anew = 0, materialise(stored.select(*layout.folders).distinct(), "touched-partitions"), True
    else:
        touched = materialise(gone.select(*layout.folders).distinct(), "touched-partitions")
        anew = False
    new = None if fresh is None else layout.bucketed(fresh, id_col, write)
    writes = touched.select(*layout.partition_by, layout.first_bucket().alias("bucket")).distinct()
    blanks = {"postings": touched, "terms": writes, "sizes": touched, "forward": touched}

    def copied(table: str) -> DataFrame:
        """What is left of the partitions that lose rows; of forward for the terms also the other buckets of their writes."""
        rows = stored if table != "postings" else _stored(spark, path, layout, table)
        lost = blanks[table]
        buckets = [r[0] for r in lost.select("bucket").distinct().collect()]
        own = layout.first_bucket() if table == "terms" else F.col("bucket")
        place = [*layout.partition_by, "__bucket"]
        rows = rows.filter("doc IS NOT NULL").withColumn("__bucket", own).filter(F.col("__bucket").isin(buckets))
        if layout.partition_by:
            on = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in place])
            rows = rows.alias("r").join(broadcast_if_small(lost.withColumnRenamed("bucket", "__bucket")).alias("t"), on, "left_semi")
        return left(rows.drop("__bucket"))

    made = {"postings": _posted, "terms": _term_counts, "sizes": _sizes, "forward": lambda _, rows: rows}
    for table in _TABLES:
        build = made[table]
        if anew:
            rows = build(layout, new)
        elif table == "postings":
            rows = copied(table) if new is None else copied(table).unionByName(build(layout, new))
        else:
            rows = build(layout, copied(table) if new is None else copied(table).unionByName(new))
        _write_table(path, table, layout, rows, blanks[table], balance and bool(layout.partition_by))
    release_scratch(spark, mark)


def _stored_params(spark: SparkSession, path: str, params: Bm25Params | None) -> Bm25Params:
    stored = read_params(spark, Bm25Params, f"{path}/params")
    if params is not None and params != stored:
        raise ValueError(f"the index has {stored}, not {params}")
    return stored


def has_index(spark: SparkSession, path: str) -> bool:
    return has_files(spark, f"{path}/forward/_SUCCESS")


def write_index(
    docs: DataFrame, id_col: str, text_col: str, path: str, params: Bm25Params | None = None, mode: str = "overwrite",
    keep: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), buckets: int = BUCKETS, remove: DataFrame | None = None, balance: bool = True,
    when_read: Callable[[], None] = lambda: None,
) -> TextIndex:
    """Store documents in the index and open it.

    ``overwrite`` starts anew, ``append`` adds documents whose id the index does not hold, ``upsert`` also
    replaces those it holds, and removes the ids in ``remove`` in the same write. The parameters, the analyzer among them,
    and the layout are set by the first write; later writes use them and refuse other parameters. Repeating a
    change changes nothing.

    ``partition_by`` (some of ``keep``) are folders: a search restricted by them reads no others. ``buckets`` of the id
    below them bound what a change rewrites; choose them so that a bucket is some hundred megabytes. Rows of many folders
    are dealt to write tasks by folder; without ``balance``, for documents of one folder, tasks write what they read.
    ``when_read`` is called when ``docs`` and ``remove`` are not needed any more.
    """
    spark = docs.sparkSession
    if mode not in ("append", "overwrite", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "overwrite":
        if not set(partition_by) <= set(keep):
            raise ValueError("partition columns must be kept")
        write_params(spark, params or Bm25Params(), f"{path}/params")
        rows = forward_rows(docs, id_col, text_col, params or Bm25Params(), keep).filter(F.col(id_col).isNotNull())
        layout = _Layout(rows.schema, tuple(partition_by), buckets)
        layout.save(spark, path)
        balance = balance and bool(partition_by)
        # Tokenise once: forward is written first here, and the other tables from it.
        _write_table(path, "forward", layout, layout.bucketed(_numbered(rows), id_col), None, balance)
        when_read()
        forward = _stored(spark, path, layout, "forward")
        for table, build in (("terms", _term_counts), ("postings", _posted), ("sizes", _sizes)):
            _write_table(path, table, layout, build(layout, forward), None, balance)
        return open_index(spark, path, id_col)
    params = _stored_params(spark, path, params)
    layout = _Layout.load(spark, path)
    mark = scratch_mark()
    if mode == "append":
        # Ids are compared before texts are read, and texts before their terms are counted.
        held = _stored(spark, path, layout, "forward").select(id_col)
        absent = materialise(docs.select(id_col).join(held, id_col, "left_anti").distinct(), "absent-ids")
        docs = docs.join(broadcast_if_small(absent), id_col, "left_semi")
    fresh = forward_rows(docs, id_col, text_col, params, keep).filter(F.col(id_col).isNotNull())
    fresh = materialise(_numbered(fresh), "indexed-documents", compression=_CODEC, block_bytes=_BLOCK_BYTES)
    remove = None if remove is None else materialise(remove.select(id_col), "removed-ids")
    when_read()
    _change(spark, path, id_col, fresh, remove, balance)
    release_scratch(spark, mark)
    return open_index(spark, path, id_col)


def delete_from_index(ids: DataFrame, path: str, id_col: str) -> TextIndex:
    """Remove documents by id; unknown ids do no harm."""
    _change(ids.sparkSession, path, id_col, None, ids)
    return open_index(ids.sparkSession, path, id_col)


def open_index(spark: SparkSession, path: str, id_col: str) -> TextIndex:
    layout = _Layout.load(spark, path)
    tables = {t: _stored(spark, path, layout, t) for t in _TABLES}
    sums = tables["sizes"].agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))
    forward, slim = tables["forward"].filter(F.col(id_col).isNotNull()), tables["postings"].filter("term IS NOT NULL")
    # A posting has its document's number; numbers are unique in a write, so in a bucket, whatever the other folders.
    described = forward.select("bucket", "doc", *[c for c in layout.schema.fieldNames() if c != "counts" and c not in layout.partition_by])
    whole = lambda rows: rows.join(described, ["bucket", "doc"]).drop("bucket", "doc")
    columns = [*[c for c in layout.schema.fieldNames() if c != "counts"], "term", "tf"]
    return TextIndex(
        postings=whole(slim).select(*columns),
        terms=tables["terms"].filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")),
        collection=sums.select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.try_divide("n_terms", "n_docs").alias("avg_dl")),
        id_col=id_col,
        params=read_params(spark, Bm25Params, f"{path}/params"),
        forward=forward.drop("bucket", "doc"),
        stored=True,
        matching=lambda weights: whole(slim.join(weights, "term")),
    )


def query_terms(queries: DataFrame, query_id: str, text_col: str, params: Bm25Params = Bm25Params()) -> DataFrame:
    """``(query_id, term, qtf)``; a repeated term counts once per occurrence."""
    counts = queries.select(F.col(query_id).alias("query_id"), F.inline(term_counts(_tokens(text_col, params))))
    return counts.select("query_id", "term", F.col("tf").cast("double").alias("qtf"))


def bm25_search(
    queries: DataFrame, index: TextIndex, k: int = LEXICAL_TOP_K,
    query_id: str = "query_id", text_col: str = "text", fuzzy: bool = False, transpositions: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """Best ``k`` documents of each query: ``(query_id, rank, <id>, score)``.

    Terms are alternatives (any may match). With ``fuzzy`` a query term also matches vocabulary
    terms within the automatic edit distance, weighted down by the share of edits. ``where``
    restricts the documents by columns kept in the index; the statistics are theirs alone.
    """
    if where is not None:
        index = restrict(index, where)
    wanted = query_terms(queries, query_id, text_col, index.params)
    if fuzzy:
        # The vocabulary is read several times: count its terms once.
        vocabulary = spread(materialise(index.terms.select("term"), "vocabulary"))
        near = expand_terms(wanted.select("term").distinct(), vocabulary, transpositions)
        wanted = (
            wanted.join(near, "term")
            .select("query_id", F.col("match").alias("term"), (F.col("qtf") * F.col("weight")).alias("qtf"))
            .groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
        )
        # Used to size the join, to weigh the terms and to score: compute the expansion once.
        wanted = materialise(wanted, "expanded-terms")
    scored = None
    if index.forward is not None:
        scored = _scan_in_groups(index, wanted, k)
    if scored is None:
        scored = _join_scores(index, wanted, F.broadcast if fits_broadcast(wanted) else (lambda df: df))
    ranked = top_k(scored, ["query_id"], [F.desc("score"), F.asc(index.id_col)], k)
    return ranked.select("query_id", "rank", index.id_col, "score")


def _scan_in_groups(index: TextIndex, wanted: DataFrame, k: int) -> DataFrame | None:
    """Best ``k`` per query and scan task, by a scan for every group of queries; None where a join does better."""
    n = wanted.count()
    if not n or n > SCAN_MAX_GROUPS * SCAN_MAX_WEIGHTS or (index.stored and _selective(index, wanted)):
        return None
    if n <= SCAN_MAX_WEIGHTS:
        return _scan_scores(index, wanted, k)
    groups: list[list] = [[]]
    held = 0
    for query, size in wanted.groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").toLocalIterator():
        if query is None or size > SCAN_MAX_WEIGHTS:
            return None
        if held + size > SCAN_MAX_WEIGHTS:
            groups.append([])
            held = 0
        groups[-1].append(query)
        held += size
    of_group = lambda queries: wanted.filter(F.col("query_id").between(queries[0], queries[-1]))
    return reduce(DataFrame.unionByName, [_scan_scores(index, of_group(queries), k) for queries in groups])


def _join_scores(index: TextIndex, wanted: DataFrame, hint) -> DataFrame:
    """Score of every query and document that share a term, by joining postings and adding up."""
    n_docs = index.collection.select("n_docs").scalar()
    avg_dl = index.collection.select("avg_dl").scalar()
    k1, b = F.lit(index.params.k1), F.lit(index.params.b)
    df, tf, dl = F.col("df"), F.col("tf"), F.col("dl")
    idf = F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    weights = (
        index.terms.join(hint(wanted), "term")
        .select("query_id", "term", (F.col("qtf") * idf * (k1 + F.lit(1.0))).alias("weight"))
    )
    gain = F.col("weight") * tf / (tf + k1 * (F.lit(1.0) - b + b * dl / avg_dl))
    matched = index.postings.join(hint(weights), "term") if index.matching is None else index.matching(hint(weights))
    return matched.groupBy("query_id", index.id_col).agg(rounded(F.sum(gain)).alias("score"))


# A stored index is joined by term while the join touches less than this share of the postings.
SELECTIVE_SHARE = 0.25


def _selective(index: TextIndex, wanted: DataFrame) -> bool:
    """Whether the postings of the wanted terms, once per query, are a small part of the index."""
    uses = wanted.groupBy("term").agg(F.count("*").alias("uses"))
    df = F.col("df")
    touched, total = index.terms.join(F.broadcast(uses), "term", "left").agg(
        F.sum(F.coalesce("uses", F.lit(0)) * df), F.sum(df)
    ).first()
    return (touched or 0) <= SELECTIVE_SHARE * (total or 0)


def _scan_rows(index: TextIndex) -> DataFrame:
    """``(id, dl, terms, tfs)`` per document; where its tokens are not counted yet, ``terms`` are its tokens and ``tfs`` is null."""
    if index.tokens is not None:
        tfs = F.lit(None).cast("array<int>")
        return index.tokens.select(index.id_col, F.size("tokens").alias("dl"), F.col("tokens").alias("terms"), tfs.alias("tfs"))
    return index.forward.select(index.id_col, "dl", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"))


def _found_terms(part: pa.RecordBatch, lookup: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (place in the batch), term (place in ``lookup``) and count, by document and term."""
    lists = part.column("terms")
    sizes = np.asarray(pc.fill_null(lists.value_lengths(), 0))  # a null text has no terms
    found = pc.index_in(lists.flatten(), lookup)
    hit = np.asarray(found.is_valid())
    term = np.asarray(found.drop_null()).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)[hit]
    if part.column("tfs").null_count < len(part):
        return doc, term, np.asarray(part.column("tfs").flatten(), dtype=float)[hit]
    keys, tf = np.unique(doc * len(lookup) + term, return_counts=True)
    return keys // len(lookup), keys % len(lookup), tf.astype(float)


def _wanted_stats(index: TextIndex, wanted: DataFrame, vocabulary: np.ndarray) -> pd.DataFrame:
    """Document frequency of the wanted terms, and in the row of the empty term the number of
    documents and their total length. Without a stored index: one pass over the documents."""
    if index.stored:
        names = wanted.select("term").distinct()
        known = index.terms.join(F.broadcast(names), "term", "left_semi").withColumn("cf", F.lit(0))
        n_docs, average = index.collection.select("n_docs", "avg_dl").first()
        whole = pd.DataFrame({"term": [""], "df": [n_docs or 0], "cf": [(n_docs or 0) * (average or 0.0)]})
        return pd.concat([known.select("term", "df", "cf").toPandas(), whole]).set_index("term")
    shared = wanted.sparkSession.sparkContext.broadcast(vocabulary.tolist())
    slice_terms = _SLICE_TERMS

    def count(batches):
        lookup = pa.array(shared.value, pa.string())
        df, n_docs, total = np.zeros(len(lookup), dtype=np.int64), 0, 0
        for batch in batches:
            lengths = np.asarray(pc.fill_null(batch.column("dl"), 0))
            n_docs, total = n_docs + int((lengths > 0).sum()), total + int(lengths.sum(dtype=np.int64))
            for part in list_slices(batch.column("terms"), slice_terms):
                df += np.bincount(_found_terms(batch[part], lookup)[1], minlength=len(lookup))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([lookup.take(pa.array(some)), pa.array([""])]), pa.array([*df[some].tolist(), n_docs], pa.int64()),
            pa.array([0] * len(some) + [total], pa.int64()),
        ], ["term", "df", "cf"])

    stats = _scan_rows(index).drop(index.id_col).mapInArrow(count, "term string, df long, cf long").groupBy("term")
    return stats.agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).toPandas().set_index("term")


def _scan_scores(index: TextIndex, wanted: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query and scan task, by two passes over the documents: statistics, then scores.

    A document's terms are in one row, so its scores are complete inside the task, and no pair of
    query and document is shuffled except the few that can still win. ``wanted`` was counted and has
    at most ``SCAN_MAX_WEIGHTS`` rows.
    """
    table = wanted.toPandas()
    vocabulary, term_of = np.unique(table["term"].to_numpy(dtype=object), return_inverse=True)
    query_ids, query_of = np.unique(table["query_id"].to_numpy(), return_inverse=True)
    stats = _wanted_stats(index, wanted, vocabulary)
    n_docs, total = stats.loc[""] if "" in stats.index else (0, 0)
    average = total / n_docs if n_docs else 1.0
    k1, b, id_col = index.params.k1, index.params.b, index.id_col
    df = stats["df"].reindex(vocabulary).fillna(0).to_numpy()
    idf = np.where(df > 0, np.log1p((n_docs - df + 0.5) / (df + 0.5)), 0.0)
    # Weights by term: the entries of term t are those from starts[t] up to starts[t + 1].
    order = np.argsort(term_of, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term_of, minlength=len(vocabulary)))])
    values = table["qtf"].to_numpy()[order] * idf[term_of[order]] * (k1 + 1.0)
    shared = wanted.sparkSession.sparkContext.broadcast((vocabulary.tolist(), query_ids, starts, query_of[order], values))
    slice_terms = _SLICE_TERMS

    def score(batches):
        vocabulary, query_ids, starts, query_of, values = shared.value
        lookup = pa.array(vocabulary, pa.string())
        fanout = np.diff(starts)
        best = None
        for batch in (whole[part] for whole in batches for part in list_slices(whole.column("terms"), slice_terms)):
            doc, term, tf = _found_terms(batch, lookup)
            dl = np.asarray(batch.column("dl"), dtype=float)[doc]
            gain = tf / (tf + k1 * (1.0 - b + b * dl / average))
            ids = batch.column(id_col).to_pandas()
            # Whole documents, about _BLOCK_VALUES products at a time.
            products = np.cumsum(fanout[term])
            first = 0
            while first < len(doc):
                done = products[first - 1] if first else 0
                stop = int(np.searchsorted(products, done + _BLOCK_VALUES, side="right"))
                stop = max(stop, first + 1)
                stop = int(np.searchsorted(doc, doc[stop - 1], side="right")) if stop < len(doc) else stop
                part = slice(first, stop)
                times = fanout[term[part]]
                at = np.arange(times.sum()) + np.repeat(starts[term[part]] - (np.cumsum(times) - times), times)
                pair = np.repeat(doc[part], times) * len(query_ids) + query_of[at]
                keys, place = np.unique(pair, return_inverse=True)
                sums = np.bincount(place, weights=values[at] * np.repeat(gain[part], times), minlength=len(keys))
                scaled = 10.0 ** SCORE_DIGITS
                top = pd.DataFrame({
                    "query_id": query_ids[keys % len(query_ids)], "id": ids.to_numpy()[keys // len(query_ids)],
                    "score": np.floor(sums * scaled + 0.5) / scaled,
                })
                best = merge_pairs([top] if best is None else [best, top], k, True)
                first = stop
        if best is not None and len(best):
            yield pa.RecordBatch.from_pandas(best, schema=arrow_schema, preserve_index=False)

    id_type = index.forward.schema[id_col].dataType
    query_type = wanted.schema["query_id"].dataType
    schema = StructType([
        StructField("query_id", query_type), StructField("id", id_type), StructField("score", DoubleType())
    ])
    arrow_schema = to_arrow_schema(schema)
    return _scan_rows(index).mapInArrow(score, schema).withColumnRenamed("id", id_col)


def merge_hits(hits: DataFrame, key: list[str], query_pos: str = "query_id") -> DataFrame:
    """Union of the hits of several queries without repeats; the first query that found a row keeps it.

    ``min_by`` combines on the map side, so a row that very many queries found costs one row per task.
    """
    others = [c for c in hits.columns if c not in key]
    first = F.min_by(F.struct(*others), F.struct(query_pos, "rank"))
    return hits.groupBy(*key).agg(first.alias("__hit")).select(*key, "__hit.*")


# --- fuzzy terms -----------------------------------------------------------------------------

# Query terms up to this length are matched by deletion neighbourhoods, longer ones by shared
# pieces: neighbourhoods grow with the square of the length, pieces do not grow.
NEIGHBOURHOOD_MAX = 16
_MAX_EDITS = 2
_PIECES = 2 * _MAX_EDITS + 1


def allowed_edits(term) -> "F.Column":
    """Automatic distance: 0 up to two characters, 1 up to five, 2 above."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _deletions(term, edits):
    """The term and all results of removing up to ``edits`` characters."""

    def once(t):
        n = F.length(t)
        cut = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)),
        )
        return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))

    own = F.array(term)
    one = F.concat(own, once(term))
    two = F.concat(one, F.flatten(F.transform(once(term), once)))
    return F.array_distinct(F.when(edits >= 2, two).when(edits == 1, one).otherwise(own))


def _pieces(term):
    """``_PIECES`` consecutive pieces of a term: struct(number, total length, start, text)."""
    n = F.length(term)

    def piece(i):
        start = F.floor(i * n / _PIECES).cast("int")
        stop = F.floor((i + 1) * n / _PIECES).cast("int")
        return F.struct(
            i.alias("piece"), n.alias("length"), (start + 1).alias("start"),
            F.substring(term, start + 1, stop - start).alias("text"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(_PIECES - 1)), piece)


def _windows(term):
    """Where pieces of a term of a length within two edits could lie in this term."""
    n = F.length(term)

    def of_length(length):
        def of_piece(i):
            start = F.floor(i * length / _PIECES).cast("int")
            stop = F.floor((i + 1) * length / _PIECES).cast("int")
            return F.transform(
                F.sequence(F.lit(-_MAX_EDITS), F.lit(_MAX_EDITS)),
                lambda shift: F.struct(
                    i.alias("piece"), length.alias("length"), (start + 1).alias("start"),
                    F.substring(term, start + 1 + shift, stop - start).alias("text"),
                ),
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_PIECES - 1)), of_piece))

    lengths = F.sequence(n - _MAX_EDITS, n + _MAX_EDITS)
    return F.flatten(F.transform(lengths, of_length))


@F.pandas_udf(IntegerType())
def _alignment_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which swapping two neighbours is one edit (optimal string alignment)."""

    def distance(s: str, t: str) -> int:
        before, last = [], list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            row = [i]
            for j, y in enumerate(t, 1):
                best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
                if i > 1 and j > 1 and x == t[j - 2] and s[i - 2] == y:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    return pd.Series([distance(s, t) for s, t in zip(a, b)])


def expand_terms(wanted: DataFrame, vocabulary: DataFrame, transpositions: bool = False) -> DataFrame:
    """``(term, match, edits, weight)`` of the vocabulary terms near each wanted term.

    Equi joins propose candidates and the distance decides. Short terms share a string left by
    deleting characters; of a long term cut into five pieces at least one survives two edits and
    is found within two places of where it was. Both are exact, so no candidate is capped.
    """
    terms = wanted.select("term", allowed_edits(F.col("term")).alias("limit"))
    words = vocabulary.select(F.col("term").alias("match"))

    exact = terms.join(words.withColumnRenamed("match", "term"), "term", "left_semi")
    exact = exact.select("term", F.col("term").alias("match"))

    near = terms.filter(F.col("limit") > 0)
    # A vocabulary term never needs more deletions than its own length allows: where it is shorter
    # than the wanted term, the difference in length uses up edits.
    short = near.filter(F.length("term") <= NEIGHBOURHOOD_MAX).select(
        "term", F.explode(_deletions(F.col("term"), F.col("limit"))).alias("key")
    )
    short_words = words.filter(
        (F.length("match") >= 2) & (F.length("match") <= NEIGHBOURHOOD_MAX + _MAX_EDITS)
    ).select("match", F.explode(_deletions(F.col("match"), allowed_edits(F.col("match")))).alias("key"))
    long = near.filter(F.length("term") > NEIGHBOURHOOD_MAX).select(
        "term", F.explode(_pieces(F.col("term"))).alias("key")
    )
    long_words = words.filter(F.length("match") > NEIGHBOURHOOD_MAX - _MAX_EDITS).select(
        "match", F.explode(_windows(F.col("match"))).alias("key")
    )
    limit = allowed_edits(F.col("term"))
    candidates = (
        short_words.join(broadcast_if_small(short), "key").select("term", "match")
        .unionByName(long_words.join(broadcast_if_small(long), "key").select("term", "match"))
        .filter((F.abs(F.length("term") - F.length("match")) <= limit) & (F.col("term") != F.col("match")))
    )
    if transpositions:
        # The Python distance is the dear part: remove repeats first.
        measured = candidates.distinct().withColumn("edits", _alignment_distance("term", "match"))
    else:
        measured = candidates.withColumn("edits", F.levenshtein("term", "match", _MAX_EDITS))
    verified = measured.filter((F.col("edits") >= 0) & (F.col("edits") <= limit))
    if not transpositions:
        verified = verified.distinct()
    everything = verified.unionByName(exact.withColumn("edits", F.lit(0)))
    shorter = F.least(F.length("term"), F.length("match"))
    return everything.withColumn("weight", F.lit(1.0) - F.col("edits") / shorter)

