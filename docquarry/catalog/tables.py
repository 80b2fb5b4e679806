"""Maintenance, registry and name functions on the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.base import query, table
from docquarry.functions import names
from docquarry.functions.keys import display_time, ingest_date
from docquarry.operators import maintenance, validate
from docquarry.session import scratch_path
from docquarry.sources.registry import add_absent, init_registry, read_registry


@query("""
SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, arg_max(text, turn) AS text
FROM conversations GROUP BY conv_id
""")
def upsert_latest(spark, folder):
    """Assistant turns stored first, then all others sent in: the latest turn per conversation stays."""
    turns = table(spark, folder, "conversations")
    first = F.col("role") == "assistant"
    merged = maintenance.latest(
        maintenance.upsert(turns.filter(first), turns.filter(~first), ["conv_id", "turn"], ["text"]), ["conv_id"], ["turn"]
    )
    return merged.select("conv_id", "role", "turn", "text")


@query("""
WITH sent AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1),
known AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
SELECT sum(n)::bigint AS sent, count(*) AS written, count(known.user_id) AS updated, count(*) - count(known.user_id) AS inserted
FROM sent LEFT JOIN known USING (user_id)
""")
def upsert_report(spark, folder):
    events = table(spark, folder, "events")
    return maintenance.upsert_report(
        events.filter("event_type = 'view'"), events.filter("event_type <> 'view'"), ["user_id"]
    )


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(spark, folder):
    toxic = table(spark, folder, "labels").filter("toxic = 1")
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return maintenance.delete_by_ids(rows, toxic, "doc_id")


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1997-01-01') GROUP BY o_custkey
""")
def insert_if_absent(spark, folder):
    """Customers of later orders who are not known from earlier ones are added once, by their first order."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    known = orders.filter("o_orderdate < DATE '1997-01-01'").select("o_custkey", "o_orderkey")
    return maintenance.insert_if_absent(known, orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def already_present(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    return maintenance.present(rows, table(spark, folder, "labels"), ["doc_id"])


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def active_only(spark, folder):
    """Status flag filter."""
    return maintenance.active_only(table(spark, folder, "labels"), "quality").select("doc_id", "quality", "toxic")


@query("""
SELECT user_id, knowledge_id, file_id, l_linenumber, l_extendedprice, o_orderpriority, c_mktsegment, n_name
FROM (SELECT l_orderkey AS file_id, l_linenumber, l_extendedprice FROM lineitem)
LEFT JOIN (SELECT o_orderkey AS file_id, o_custkey AS knowledge_id, o_orderpriority FROM orders) USING (file_id)
LEFT JOIN (SELECT c_custkey AS knowledge_id, c_nationkey AS user_id, c_mktsegment FROM customer) USING (knowledge_id)
LEFT JOIN (SELECT n_nationkey AS user_id, n_name FROM nation) USING (user_id)
""")
def star_enrich(spark, folder):
    """Chunk, file, knowledge base and user, played by lineitem, orders, customer and nation."""
    chunks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_extendedprice")
    files = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("knowledge_id"), "o_orderpriority"
    )
    bases = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("knowledge_id"), F.col("c_nationkey").alias("user_id"), "c_mktsegment"
    )
    users = table(spark, folder, "nation").select(F.col("n_nationkey").alias("user_id"), "n_name")
    return maintenance.enrich_chunks(chunks, files, bases, users)


_UPLOADS = """
names AS (SELECT o_orderkey AS file_key, o_orderpriority AS file_name FROM orders),
urls AS (SELECT o_orderkey AS file_key, 'bucket/' || o_orderkey AS file_url FROM orders WHERE o_orderstatus <> 'P'),
paths AS (SELECT o_orderkey AS file_key, '/data/' || o_orderkey AS file_path FROM orders WHERE o_totalprice > 100000)
"""


@query(f"""
WITH {_UPLOADS}
SELECT file_key, file_name, coalesce(file_url, '') AS file_url, coalesce(file_path, '') AS file_path,
    file_url IS NULL OR file_path IS NULL AS failed
FROM names LEFT JOIN urls USING (file_key) LEFT JOIN paths USING (file_key)
""")
def align_uploads(spark, folder):
    """Names, URLs and paths joined by key; a failed upload keeps its row and no other row moves."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "file_key")
    done, failed = maintenance.align_uploads(
        orders.select("file_key", F.col("o_orderpriority").alias("file_name")),
        orders.filter("o_orderstatus <> 'P'").select("file_key", F.concat(F.lit("bucket/"), "file_key").alias("file_url")),
        orders.filter("o_totalprice > 100000").select("file_key", F.concat(F.lit("/data/"), "file_key").alias("file_path")),
    )
    both = done.withColumn("failed", F.lit(False)).unionByName(failed.withColumn("failed", F.lit(True)))
    return both.fillna("", ["file_url", "file_path"])


_CLEAN_SQL = r"replace(regexp_replace(url_decode(replace(url, '/en/', '%2F%EF%BC%81en%20')), '[\x{FF01}-\x{FF5E}\x{3000}-\x{303F}]', '', 'g'), '/', '_')"
_EXT_SQL = r"regexp_extract(n, '[^.](\.[^.]*)$', 1)"


@query(f"""
SELECT page_id, CASE WHEN length(n) > 50
    THEN substr(n, 1, least(41 - length(substr({_EXT_SQL}, 1, 40)), length(n) - length({_EXT_SQL}))) || '_' || substr(md5(n), 1, 8)
        || substr({_EXT_SQL}, 1, 40)
    ELSE n END AS file_name
FROM (SELECT page_id, {_CLEAN_SQL} AS n FROM pages)
""")
def clean_filename(spark, folder):
    """Page addresses as uploaded file names, with an encoded separator, a full-width sign and a space put in."""
    raw = F.replace(F.col("url"), F.lit("/en/"), F.lit("%2F%EF%BC%81en%20"))
    return table(spark, folder, "pages").select("page_id", names.clean_file_name(raw).alias("file_name"))


@query(r"""
SELECT page_id, b AS base_name, split_part(b, '.', 1) AS stem,
    CASE WHEN regexp_matches(b, '[^.]\.html$') THEN 'text/html' ELSE 'unknown' END AS media_type,
    replace(url || ' copy', ' ', '%20') AS escaped
FROM (SELECT *, list_extract(string_split(url, '/'), -1) AS b FROM pages)
""")
def file_names(spark, folder):
    """Base name, stem, media type and escaped address."""
    return table(spark, folder, "pages").select(
        "page_id", names.base_name("url").alias("base_name"), names.stem("url").alias("stem"),
        F.coalesce(names.media_type("url"), F.lit("unknown")).alias("media_type"),
        names.escape_spaces(F.concat("url", F.lit(" copy"))).alias("escaped"),
    )


@query("""
SELECT c_custkey, 'knowledge_name_' || c_custkey AS collection, 'documents-' || c_custkey AS bucket,
    'documents-' || c_custkey || '/' || c_name AS object_path, lower(c_name) AS index_name,
    trim('  ' || c_mktsegment || ' ') AS partition_name
FROM customer
""")
def collection_names(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", names.collection_name("c_custkey").alias("collection"), names.bucket_name("c_custkey").alias("bucket"),
        names.object_path("c_custkey", "c_name").alias("object_path"), names.index_name("c_name").alias("index_name"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("partition_name"),
    )


# Readings of the ten digits.
DIGITS = {"零": "ling", "一": "yi", "二": "er", "三": "san", "四": "si",
          "五": "wu", "六": "liu", "七": "qi", "八": "ba", "九": "jiu"}


def _nested_replace(text: str) -> str:
    for digit, reading in enumerate(DIGITS.values()):
        text = f"replace({text}, '{digit}', '{reading}')"
    return text


@query(f"""
SELECT c_custkey, has_han, CASE WHEN has_han THEN {_nested_replace('name')} ELSE name END AS reading
FROM (SELECT c_custkey, c_acctbal >= 0 AS has_han, c_mktsegment || c_custkey AS name FROM customer)
""")
def transliterate_names(spark, folder):
    """Customer numbers written in Han digits (for balances of 0 and more) and read back."""
    plain = F.concat("c_mktsegment", F.col("c_custkey").cast("string"))
    named = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.translate(plain, "0123456789", "".join(DIGITS))).otherwise(plain).alias("name"),
    )
    mapping = spark.createDataFrame(list(DIGITS.items()), "character string, reading string")
    read = names.transliterate(named, "name", mapping, "reading")
    return read.select("c_custkey", names.has_han("name").alias("has_han"), "reading")


@query("""
SELECT *, CASE WHEN NOT name_ok THEN 'name_length' WHEN NOT status_ok THEN 'status_value'
    WHEN NOT id_ok THEN 'id_not_positive' ELSE 'ok' END AS error_code
FROM (SELECT user_id, user_name, user_status, length(user_name) BETWEEN 3 AND 20 AS name_ok,
        user_status IN (0, 1) AS status_ok, user_id > 0 AS id_ok
    FROM (SELECT c_custkey AS user_id, substr(c_name || c_mktsegment, 1, c_nationkey) AS user_name,
        (c_custkey % 3)::int AS user_status FROM customer))
""")
def validate_rows(spark, folder):
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.substring(F.concat("c_name", "c_mktsegment"), F.lit(1), F.col("c_nationkey")).alias("user_name"),
        (F.col("c_custkey") % 3).cast("int").alias("user_status"),
    )
    return validate.validate_users(users)


@query("SELECT c_custkey AS user_id, c_name AS user_name, 1::int AS user_status FROM customer")
def registry_users(spark, folder):
    """Customers registered as users; sending them again adds nobody."""
    root = scratch_path(spark, "registry")
    init_registry(spark, root)
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.lit(1).alias("user_status")
    )
    for _ in range(2):
        add_absent(users, root, "user", ["user_id"])
    return read_registry(spark, root, "user").select("user_id", "user_name", "user_status")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS ingest_date,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS display_time
FROM orders
""")
def date_formats(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", ingest_date("o_orderdate").alias("ingest_date"), display_time("o_orderdate").alias("display_time")
    )
