"""Chunking of ``documents``: ``source`` is the collection, ``lang`` the partition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docquarry.catalog.base import query, sql_fixed_chunks, table
from docquarry.functions.keys import chunk_key
from docquarry.operators import chunking
from docquarry.operators.maintenance import by_file
from docquarry.operators.maintenance import list_indexes as index_list
from docquarry.operators.validate import validate_lengths
from docquarry.plans.ingest import Store, ingest
from docquarry.session import broadcast_if_small, scratch_path, spread
from docquarry.sources.chunks import PARTITIONS, delete_chunks, scan_index, upsert_chunks, write_chunks
from docquarry.sources.files import file_manifest, read_documents
from docquarry.sources.registry import read_registry
from docquarry.sources.tables import create_table, drop_partitions, insert_chunks, list_partitions


def fixed(spark, folder, *columns):
    documents = spread(table(spark, folder, "documents").select("doc_id", *columns, "text"))
    return chunking.chunk_fixed(documents)


CHUNKS_SQL = f"""
chunk AS (SELECT doc_id, source, lang, i AS chunk_pos, substr(text, i * 90 + 1, 100) AS content
    FROM (SELECT *, {sql_fixed_chunks('text')} AS i FROM documents))
"""


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_pos, content FROM chunk")
def chunk_fixed(spark, folder):
    return fixed(spark, folder).withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


@query(f"""
WITH {CHUNKS_SQL}
SELECT doc_id, count(*) AS chunks, sum(length(content))::bigint AS characters, max(length(content))::bigint AS longest,
    count(*) FILTER (length(content) > 100) AS errors
FROM chunk GROUP BY doc_id
""")
def chunk_report(spark, folder):
    report = chunking.chunk_report(fixed(spark, folder), ["doc_id"])
    return report.withColumn("longest", F.col("longest").cast("long"))


@query()
def chunk_recursive(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return chunking.chunk_recursive(documents)


# What the splitter strips from the ends of a chunk.
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""
SELECT doc_id, 0::bigint AS n_long, md5(body) AS cover
FROM (SELECT doc_id, regexp_replace(text, '{SPACES}', '', 'g') AS body FROM documents) WHERE body <> ''
""")
def chunk_table_function(spark, folder):
    """The recursive splitter as a table function in SQL, without overlap: all chunks of a document hold its whole text."""
    chunking.register_chunker(spark)
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    chunks = spark.sql(
        "SELECT d.doc_id, c.chunk_pos, c.content FROM {documents} d, LATERAL recursive_chunks(d.text, 100, 0) c", documents=documents
    )
    held = chunks.groupBy("doc_id").agg(
        F.count_if(F.length("content") > 100).alias("n_long"), F.array_sort(F.collect_list(F.struct("chunk_pos", "content"))).alias("parts")
    )
    whole = F.array_join(F.transform("parts", lambda p: p["content"]), "")
    return held.select("doc_id", "n_long", F.md5(F.regexp_replace(whole, SPACES, "")).alias("cover"))


@query(f"""
WITH {CHUNKS_SQL}
SELECT source AS collection, lang AS partition_name, count(*) AS n_chunks, sum(length(content))::bigint AS n_chars
FROM chunk WHERE source <> (SELECT min(source) FROM documents) GROUP BY ALL
""")
def catalog_partitions(spark, folder):
    """Chunk table in the catalog: created, filled, one collection dropped by DDL, the others listed by the catalog and counted."""
    rows = fixed(spark, folder, "source", "lang").select(
        F.col("source").alias("collection"), F.col("lang").alias("partition_name"), F.col("doc_id").alias("file_id"),
        "chunk_pos", "content", chunk_key("source", "lang", "doc_id", "chunk_pos").alias("chunk_id"),
    )
    name = f"chunks_{uuid.uuid4().hex}"
    create_table(spark, name, scratch_path(spark, "catalog-chunks"))
    insert_chunks(rows, name)
    first = table(spark, folder, "documents").agg(F.min("source")).first()[0]
    if first is not None:
        drop_partitions(spark, name, first)
    counts = spark.table(name).groupBy(*PARTITIONS).agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("n_chars")
    )
    return list_partitions(spark, name).join(counts, PARTITIONS)


@query(f"""
WITH {CHUNKS_SQL}
SELECT source AS collection, lang AS partition_name, count(*) AS n_chunks, count(*) AS n_keys FROM chunk GROUP BY ALL
""")
def chunk_key_check(spark, folder):
    """Chunk keys are unique: as many keys as chunks in every partition."""
    keyed = fixed(spark, folder, "source", "lang").withColumn("key", chunk_key("source", "lang", "doc_id", "chunk_pos"))
    return keyed.groupBy(F.col("source").alias("collection"), F.col("lang").alias("partition_name")).agg(
        F.count("*").alias("n_chunks"), F.countDistinct("key").alias("n_keys")
    )


@query(f"""
WITH {CHUNKS_SQL}
SELECT doc_id, chunk_pos, content FROM chunk WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def by_file_term(spark, folder):
    """Term lookup of every labelled document: all its chunks."""
    found = by_file(fixed(spark, folder), table(spark, folder, "labels"), "doc_id")
    return found.select("doc_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "content")


@query("""
SELECT source, lang, count(*) AS n_rows, count(DISTINCT doc_id) AS n_files, sum(length(text))::bigint AS n_chars
FROM documents GROUP BY ALL
""")
def list_indexes(spark, folder):
    return index_list(table(spark, folder, "documents"), "source", "lang", "doc_id", "text")


@query(f"""
WITH {CHUNKS_SQL}
SELECT source AS collection, lang AS partition_name, doc_id AS file_id, chunk_pos, content FROM chunk
""")
def full_scan(spark, folder):
    """Chunk table written partitioned by collection and partition name, then read back whole."""
    rows = fixed(spark, folder, "source", "lang").select(
        F.col("source").alias("collection"), F.col("lang").alias("partition_name"), F.col("doc_id").alias("file_id"),
        "chunk_pos", "content", chunk_key("source", "lang", "doc_id", "chunk_pos").alias("chunk_id"),
    )
    path = scratch_path(spark, "chunks")
    write_chunks(rows, path)
    return scan_index(spark, path).select(
        "collection", "partition_name", "file_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "content"
    )


@query(f"""
WITH {CHUNKS_SQL}
SELECT source AS collection, lang AS partition_name, doc_id AS file_id, chunk_pos,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || content ELSE content END AS content
FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def store_maintenance(spark, folder):
    """A stored chunk table after an upsert (chunks of labelled documents) and a delete (toxic ones)."""
    rows = fixed(spark, folder, "source", "lang").select(
        F.col("source").alias("collection"), F.col("lang").alias("partition_name"), F.col("doc_id").alias("file_id"),
        "chunk_pos", "content", chunk_key("source", "lang", "doc_id", "chunk_pos").alias("chunk_id"),
    )
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "file_id")
    labelled, toxic = (broadcast_if_small(part.select("file_id").distinct()) for part in (labels, labels.filter("toxic = 1")))
    path = scratch_path(spark, "chunks")
    write_chunks(rows, path)
    changed = rows.join(labelled, "file_id", "left_semi")
    upsert_chunks(changed.withColumn("content", F.concat(F.lit("v2 "), "content")), path)
    delete_chunks(rows.join(toxic, "file_id", "left_semi").select("chunk_id"), path)
    return scan_index(spark, path).select(
        "collection", "partition_name", "file_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), "content"
    )


@query("""
SELECT doc_id, CASE WHEN length(source) > 50 THEN 'source_too_long' WHEN length(text) > 4000 THEN 'text_too_long'
    ELSE 'ok' END AS error_code
FROM documents
""")
def validate_chunks(spark, folder):
    """Length rules of the stored columns, applied to whole documents."""
    return validate_lengths(table(spark, folder, "documents"), {"source": 50, "text": 4000}).select("doc_id", "error_code")


@query()
def ingest_documents(spark, folder):
    """Whole ingest: names, registry, recursive chunks, vectors, chunk table; rows written per file."""
    documents = table(spark, folder, "documents")
    sources = spread(documents.select(F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text"))
    return ingest(spark, sources, Store(scratch_path(spark, "store")), 1, "handbook", dimensions=64)


@query(f"""
WITH {CHUNKS_SQL}, kept AS (SELECT doc_id, source, count(*) AS n FROM chunk GROUP BY ALL)
SELECT doc_id || '.txt' AS file_name, n AS written, 0 AS errors FROM kept
""")
def ingest_fixed(spark, folder):
    """Whole ingest with fixed windows: rows written and refused per file, from both stores and the registry."""
    documents = table(spark, folder, "documents")
    sources = spread(documents.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text"))
    store = Store(scratch_path(spark, "store"))
    report = ingest(spark, sources, store, 1, "handbook", dimensions=64, splitter=chunking.chunk_fixed)
    files = read_registry(spark, store.registry, "file").select("file_id", "file_name")
    return report.join(files, "file_id").select(
        "file_name", *[F.col(c).cast("long").alias(c) for c in ("written", "errors")]
    )


@query("""
SELECT source, lang, count(*) AS n_rows, sum(strlen(text) + 1)::bigint AS n_bytes, sum(length(text) + 1)::bigint AS n_chars
FROM documents WHERE text IS NOT NULL GROUP BY ALL
""")
def raw_files(spark, folder):
    """Documents written as text files, then found again: bytes by the manifest, characters by reading whole files."""
    documents = table(spark, folder, "documents").select("source", "lang", "text").filter("text IS NOT NULL")
    path = scratch_path(spark, "raw-files")
    documents.write.option("maxRecordsPerFile", 500).partitionBy("source", "lang").text(path)
    place = lambda c: [F.regexp_extract(c, f"/{name}=([^/]*)/", 1).alias(name) for name in ("source", "lang")]
    by = ["source", "lang"]
    sizes = file_manifest(spark, path).select(*place("path"), "n_bytes").groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes"))
    read = read_documents(spark, path).select(*place("path"), F.length("text").alias("n"))
    rows = documents.groupBy(*by).agg(F.count("*").alias("n_rows"))
    return rows.join(sizes, by).join(read.groupBy(*by).agg(F.sum("n").cast("long").alias("n_chars")), by)
