"""Lexical search over ``documents`` with the texts of ``benchmark`` as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog.base import query, sql_tokens, table
from docquarry.functions.text import tokenize
from docquarry.operators.lexical import (
    bm25_search, corpus_stats as collection_stats, delete_from_index, expand_terms, index_of, merge_hits, postings, write_index,
)
from docquarry.operators.segmentation import segment_words
from docquarry.params import Bm25Params
from docquarry.session import broadcast_if_small, materialise, scratch_path, spread


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_index(spark: SparkSession, folder: str):
    return index_of(spread(table(spark, folder, "documents")), "doc_id", "text")


TOKENS_SQL = f"""
tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY ALL),
stat AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM lens),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
qterms AS (SELECT query_id, term, count(*)::double AS qtf FROM (
    SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL)
"""

BM25_SQL = """
scored AS (
    SELECT query_id, doc_id, round(sum(
        qtf * ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.3::double
        / (tf + 1.3::double * (0.4::double + 0.6::double * dl / avg_dl))), 9) AS score
    FROM qterms JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (doc_id), stat
    GROUP BY ALL),
lexical AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scored QUALIFY rank <= 10)
"""


def bm25_over(documents: str, queries: str = "benchmark", tokens: str = "") -> str:
    """The BM25 statements over a sub-query in place of ``documents``, and other queries."""
    text = TOKENS_SQL.replace("FROM documents", f"FROM ({documents})").replace("FROM benchmark", f"FROM ({queries})")
    if tokens:
        text = text.replace(sql_tokens("text"), tokens)
    return f"{text}, {BM25_SQL}"


def tidy(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TOKENS_SQL}, {BM25_SQL} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_topk(spark, folder):
    """Ten best documents of every benchmark text."""
    return tidy(bm25_search(benchmark_queries(spark, folder), document_index(spark, folder)))


@query(f"WITH {TOKENS_SQL}, {BM25_SQL} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_stored_index(spark, folder):
    """The same search on an index that is written to the shared folder first."""
    documents = spread(table(spark, folder, "documents"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"))
    return tidy(bm25_search(benchmark_queries(spark, folder), index))


@query(f"WITH {bm25_over('SELECT * FROM documents WHERE source = ' + repr('src3'))} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_by_collection(spark, folder):
    """Search inside one collection of a stored index: counts and lengths are the collection's own."""
    documents = spread(table(spark, folder, "documents"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"), keep=("source", "lang"), partition_by=("source",))
    return tidy(bm25_search(benchmark_queries(spark, folder), index, where=F.col("source") == "src3"))


_SHORT = "SELECT item_id, list_max(" + sql_tokens("text") + ") AS text FROM benchmark"


@query(f"WITH {bm25_over('SELECT * FROM documents', _SHORT)} SELECT query_id, rank, doc_id, score FROM lexical")
def bm25_short_queries(spark, folder):
    """One rare word per query: the stored postings of these words are joined, the documents are not read."""
    documents = spread(table(spark, folder, "documents"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"))
    short = benchmark_queries(spark, folder).select("query_id", F.array_max(tokenize("text")).alias("text"))
    return tidy(bm25_search(short, index))


_KEPT = """
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN text || ' ' || lang ELSE text END AS text
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
"""


@query(f"WITH {bm25_over(_KEPT)} SELECT query_id, rank, doc_id, score FROM lexical")
def text_index_maintenance(spark, folder):
    """A stored index after an append in two parts, a change of some documents and a delete of others, each sent twice."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, folder, "labels")
    path = scratch_path(spark, "text-index")
    write_index(documents.filter("doc_id % 2 = 0"), "doc_id", "text", path)
    good, toxic = (broadcast_if_small(labels.filter(which).select("doc_id").distinct()) for which in ("quality = 1", "toxic = 1"))
    changed = documents.join(good, "doc_id", "left_semi")
    changed = changed.withColumn("text", F.concat_ws(" ", "text", "lang"))
    for _ in range(2):
        write_index(documents, "doc_id", "text", path, mode="append")
        write_index(changed, "doc_id", "text", path, mode="upsert")
        index = delete_from_index(toxic, path, "doc_id")
        documents = documents.join(toxic, "doc_id", "left_anti")
        changed = changed.join(toxic, "doc_id", "left_anti")
    return tidy(bm25_search(benchmark_queries(spark, folder), index))


# Han characters that stand for the letters a to z in this query.
HAN_LETTERS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
_HAN_TEXT = f"translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HAN_LETTERS}')"
_HAN_TOKENS = (
    "flatten(list_transform(regexp_extract_all(text, '[一-鿿]+|[^一-鿿\\P{L}]+|\\p{N}+'), lambda w: CASE WHEN regexp_matches(w, '[一-鿿]') "
    "AND length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END))"
)
_HAN_WORDS = f"SELECT *, regexp_replace({_HAN_TEXT}, '[^一-鿿 ]', '', 'g') AS han FROM"


@query(f"""WITH {bm25_over('SELECT doc_id, han AS text FROM (' + _HAN_WORDS + ' documents)', 'SELECT item_id, han AS text FROM (' + _HAN_WORDS + ' benchmark)', _HAN_TOKENS)}
SELECT query_id, rank, doc_id, score FROM lexical""")
def bm25_han(spark, folder):
    """Search over Han text (the letters of all words written as Han characters): pairs of characters are the terms."""
    text = F.regexp_replace(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", HAN_LETTERS), "[^一-鿿 ]", "")
    documents = spread(table(spark, folder, "documents")).select("doc_id", text.alias("text"))
    path = scratch_path(spark, "text-index")
    index = write_index(documents, "doc_id", "text", path, Bm25Params(han_bigrams=True))
    return tidy(bm25_search(benchmark_queries(spark, folder).withColumn("text", text), index))


@query()
def han_words(spark, folder):
    """Documents written in Han characters without blanks, cut into words by the benchmark's words as dictionary."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    written = lambda text: F.regexp_replace(F.translate(F.lower(text), letters, HAN_LETTERS), "[^一-鿿 ]", "")
    known = table(spark, folder, "benchmark").select(F.explode(F.split(written("text"), " ")).alias("word"))
    dictionary = known.groupBy("word").agg(F.count("*").alias("n"))
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    unspaced = documents.select("doc_id", F.replace(written("text"), F.lit(" "), F.lit("")).alias("text"))
    # Nothing but Han characters is left, so one blank stands between two words; counting blanks spares a list of the words.
    words = segment_words(unspaced, "text", dictionary).select("doc_id", F.trim("text").alias("words"))
    blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    return words.select(
        "doc_id", F.when(F.col("words") == "", 0).otherwise(blanks + 1).cast("long").alias("n_words"),
        F.regexp_count("words", F.lit("[^ ]{2,}")).cast("long").alias("n_known"), F.md5(F.col("words").cast("binary")).alias("words_md5"),
    )


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}
SELECT doc_id, query_id, rank, score FROM lexical
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY query_id, rank) = 1
""")
def bm25_multi_query_merge(spark, folder):
    """Hits of all queries without repeats; the first query that found a document keeps it."""
    hits = bm25_search(benchmark_queries(spark, folder), document_index(spark, folder))
    return tidy(merge_hits(hits, ["doc_id"]).select("doc_id", "query_id", "rank", "score"))


# DuckDB's levenshtein counts bytes: accented letters are mapped to unused one-byte letters first.
_ONE_BYTE = "translate({}, 'àáâäæçèéêëìíîïñòóôöœùúûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"
_FUZZY_SQL = f"""
words AS (SELECT DISTINCT term AS match, {_ONE_BYTE.format('term')} AS m FROM tok),
wanted AS (SELECT DISTINCT term, {_ONE_BYTE.format('term')} AS t,
    CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS allowed FROM qterms),
near AS (
    SELECT term, match, levenshtein(t, m) AS edits
    FROM wanted JOIN words ON length(match) BETWEEN length(term) - allowed AND length(term) + allowed
    WHERE levenshtein(t, m) <= allowed),
expansion AS (
    SELECT term, match, edits, 1 - edits / least(length(term), length(match))::double AS weight FROM near)
"""


@query(f"""
WITH {TOKENS_SQL}, {_FUZZY_SQL}
SELECT term, match, edits::bigint AS edits, round(weight, 6) AS weight FROM expansion
""")
def fuzzy_terms(spark, folder):
    """Vocabulary terms within the automatic edit distance of every query term."""
    documents = spread(table(spark, folder, "documents"))
    vocabulary = spread(materialise(documents.select(F.explode(tokenize("text")).alias("term")).distinct(), "vocabulary"))
    wanted = benchmark_queries(spark, folder).select(F.explode(tokenize("text")).alias("term")).distinct()
    near = expand_terms(wanted, vocabulary)
    return near.withColumn("edits", F.col("edits").cast("long")).withColumn("weight", F.round("weight", 6))


@query(f"""
WITH {TOKENS_SQL}, {_FUZZY_SQL},
fq AS (SELECT query_id, match AS term, sum(qtf * weight) AS qtf FROM qterms JOIN expansion USING (term) GROUP BY ALL),
scored AS (
    SELECT query_id, doc_id, round(sum(
        qtf * ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.3::double
        / (tf + 1.3::double * (0.4::double + 0.6::double * dl / avg_dl))), 9) AS score
    FROM fq JOIN terms USING (term) JOIN post USING (term) JOIN lens USING (doc_id), stat
    GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
""")
def bm25_fuzzy(spark, folder):
    """Search in which query terms also match near terms."""
    index = document_index(spark, folder)
    return tidy(bm25_search(benchmark_queries(spark, folder), index, fuzzy=True))


@query(f"WITH {TOKENS_SQL} SELECT n_docs, round(avg_dl, 6) AS avg_dl FROM stat")
def corpus_stats(spark, folder):
    return collection_stats(spread(table(spark, folder, "documents")), "text").withColumn("avg_dl", F.round("avg_dl", 6))


@query(f"WITH {TOKENS_SQL} SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM post GROUP BY ALL")
def term_stats(spark, folder):
    """Document and collection frequency of the whole vocabulary."""
    posted = postings(spread(table(spark, folder, "documents")), "doc_id", "text")
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@query(f"""
SELECT doc_id, len({sql_tokens('text')})::bigint AS tokens,
    len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::bigint AS words
FROM documents
""")
def token_counts(spark, folder):
    from docquarry.functions.text import whitespace_tokens

    documents = spread(table(spark, folder, "documents"))
    return documents.select(
        "doc_id", F.size(tokenize("text")).cast("long").alias("tokens"), whitespace_tokens("text").cast("long").alias("words")
    )
