"""Vector search over ``embeddings`` with hashed benchmark texts as query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog.base import query, sql_tokens, table
from docquarry.functions import vectors as V
from docquarry.functions.payload import decode_embedding_payloads, encode_embedding_payloads
from docquarry.operators import embedding, ivf, knn
from docquarry.params import IvfParams
from docquarry.session import materialise, scratch_path, spread

DIMENSIONS = 64


def query_vectors(spark: SparkSession, folder: str, normalize: bool = True) -> DataFrame:
    texts = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return embedding.hash_embed(texts, "text", "query_vector", DIMENSIONS, normalize).select("query_id", "query_vector")


def search(spark, folder, metric, k=3, where=None, normalize=True):
    hits = knn.knn_exact(
        query_vectors(spark, folder, normalize), table(spark, folder, "embeddings"), k, metric, id_col="vec_id", where=where
    )
    return tidy(hits)


def tidy(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.col("rank").cast("long"))


def hashed_sql(name: str, id_col: str, source: str) -> str:
    """CTE ``<name>`` (id, counts, vec): token counts per bucket and their unit vector."""
    return f"""
{name}_tok AS (SELECT {id_col}, ('0x' || substr(md5(t), 1, 8))::bigint % {DIMENSIONS} AS bucket
    FROM (SELECT {id_col}, unnest({sql_tokens('text')}) AS t FROM {source})),
{name}_cnt AS (SELECT {id_col}, bucket, count(*)::double AS c FROM {name}_tok GROUP BY ALL),
{name}_grid AS (SELECT {id_col}, b AS bucket FROM (SELECT DISTINCT {id_col} FROM {name}_cnt), generate_series(0, {DIMENSIONS - 1}) g(b)),
{name}_den AS (SELECT {id_col}, list(coalesce(c, 0) ORDER BY bucket) AS counts, sqrt(sum(c * c)) AS norm
    FROM {name}_grid LEFT JOIN {name}_cnt USING ({id_col}, bucket) GROUP BY ALL),
{name} AS (SELECT {id_col}, counts, list_transform(counts, lambda x: x / norm) AS vec FROM {name}_den)
"""


Q_SQL = hashed_sql("q", "item_id", "benchmark")


def knn_sql(score: str, direction: str = "DESC", where: str = "TRUE") -> str:
    return f"""
WITH {Q_SQL},
scored AS (SELECT item_id AS query_id, vec_id, round({score}, 9) AS score
    FROM q, (SELECT vec_id, embedding::double[] AS e FROM embeddings WHERE {where}))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 3
"""


@query(knn_sql("list_cosine_similarity(vec, e)"))
def knn_cosine(spark, folder):
    return search(spark, folder, "cosine")


@query(knn_sql("list_inner_product(counts, e)"))
def knn_ip(spark, folder):
    """Inner product with query vectors that are not normalised."""
    return search(spark, folder, "ip", normalize=False)


@query(knn_sql("list_distance(vec, e)", "ASC"))
def knn_l2(spark, folder):
    return search(spark, folder, "l2")


@query(knn_sql("list_cosine_similarity(vec, e)", where="label = 3"))
def knn_filtered(spark, folder):
    """A metadata filter applied before scoring."""
    return search(spark, folder, "cosine", where=F.col("label") == 3)


def _index(spark, folder, nlist=64, partition_by=()):
    vectors = table(spark, folder, "embeddings")
    return ivf.build_ivf(vectors, scratch_path(spark, "ivf"), "vec_id", params=IvfParams(nlist=nlist), partition_by=partition_by)


@query(knn_sql("list_cosine_similarity(vec, e)"))
def ivf_search(spark, folder):
    """Cells are read until no other can hold a better hit."""
    return tidy(ivf.knn_ivf(query_vectors(spark, folder), _index(spark, folder), exact=True))


@query(knn_sql("list_cosine_similarity(vec, e)"))
def ivf_all_cells(spark, folder):
    """Probing every cell gives the exact result."""
    index = _index(spark, folder)
    return tidy(ivf.knn_ivf(query_vectors(spark, folder), index, nprobe=len(index.centroids)))


@query(knn_sql("list_cosine_similarity(vec, e)", where="label = 3 AND vec_id % 7 <> 0"))
def ivf_filtered(spark, folder):
    """One partition of an index that is partitioned by label and cell, and a condition on its rows."""
    index = _index(spark, folder, nlist=16, partition_by=("label",))
    hits = ivf.knn_ivf(query_vectors(spark, folder), index, exact=True, part=F.col("label") == 3, where=F.col("vec_id") % 7 != 0)
    return tidy(hits)


@query("""
SELECT label, count(*) AS vectors, round(min(norm), 6) AS norm_low, round(max(norm), 6) AS norm_high
FROM (SELECT label, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) AS norm FROM embeddings) GROUP BY label
""")
def ivf_bounds(spark, folder):
    """What the cells' bounds say of every partition of the index."""
    cells = _index(spark, folder, nlist=16, partition_by=("label",)).cells
    return cells.groupBy("label").agg(
        F.sum("n").alias("vectors"), F.round(F.min("cell_norm_low"), 6).alias("norm_low"), F.round(F.max("cell_norm_high"), 6).alias("norm_high")
    )


@query()
def ivf_recall(spark, folder):
    """Share of the exact hits with the number of probes tuned for 0.9 on half of the queries, and the cells read."""
    queries = query_vectors(spark, folder).withColumn("tuning", F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0)
    vectors = materialise(queries, "query-vectors")
    index = ivf.tune_nprobe(vectors.filter("tuning"), _index(spark, folder), target=0.9)
    found = ivf.probe_ivf(vectors, index)
    exact = knn.knn_exact(vectors, table(spark, folder, "embeddings"), id_col="vec_id")
    shares = ivf.recall(found.hits, exact, "vec_id")
    return shares.join(found.effort, "query_id").join(vectors.select("query_id", "tuning"), "query_id").withColumn(
        "cells_of", F.lit(len(index.centroids)).cast("long")
    )


def _elements(df: DataFrame, column: str) -> DataFrame:
    """One row per value: list columns are compared value by value."""
    return _exploded(df, "vec_id", column)


def _exploded(df: DataFrame, key: str, column: str) -> DataFrame:
    # Exploding an expression, not a plain column: for a column Spark adds a size filter and pushes
    # it below, which would compute the vectors twice.
    values = F.transform(column, lambda x: F.round(x.cast("double"), 6))
    return df.select(key, F.posexplode(values).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def _elements_sql(vector: str, source: str = "embeddings") -> str:
    return f"""
SELECT vec_id, pos, round(v[pos + 1], 6) AS value
FROM (SELECT vec_id, v, unnest(range(len(v))) AS pos FROM (SELECT vec_id, {vector} AS v FROM {source}))
"""


@query(_elements_sql("list_transform(embedding::double[], lambda x: 3 * x / sqrt(list_sum(list_transform(embedding::double[], lambda y: 9 * y * y))))"))
def normalize_vectors(spark, folder):
    """Unit length again after scaling by three."""
    scaled = F.transform(V.as_doubles("embedding"), lambda x: x * 3)
    return _elements(table(spark, folder, "embeddings").withColumn("v", V.l2_normalize(scaled)), "v")


@query(_elements_sql("(embedding::double[])[1:24]"))
def dims_cut(spark, folder):
    return _elements(table(spark, folder, "embeddings").withColumn("v", V.cut_dimensions("embedding", 24)), "v")


@query(_elements_sql("list_concat(embedding::double[], list_transform(range(36), lambda i: 0::double))"))
def dims_pad(spark, folder):
    return _elements(table(spark, folder, "embeddings").withColumn("v", V.fit_dimensions("embedding", 100)), "v")


@query("""
SELECT vec_id, round(list_inner_product(e, r), 6) AS ip, round(list_cosine_similarity(e, r), 6) AS cosine,
    round(list_distance(e, r), 6) AS l2
FROM (SELECT vec_id, embedding::double[] AS e, list_reverse(embedding::double[]) AS r FROM embeddings)
""")
def similarity_functions(spark, folder):
    """The three similarity expressions between each vector and its reverse."""
    rows = table(spark, folder, "embeddings").withColumn("r", F.reverse("embedding"))
    return rows.select(
        "vec_id",
        F.round(V.inner_product("embedding", "r"), 6).alias("ip"),
        F.round(V.cosine("embedding", "r"), 6).alias("cosine"),
        F.round(V.l2_distance("embedding", "r"), 6).alias("l2"),
    )


@query(_elements_sql("embedding::double[]"))
def payload_base64(spark, folder):
    """Vectors to base64 response elements and back."""
    return _round_trip(spark, folder, "base64")


@query(_elements_sql("embedding::double[]"))
def payload_json(spark, folder):
    """Vectors to float-list response elements and back."""
    return _round_trip(spark, folder, "float")


def _round_trip(spark, folder, encoding_format):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    payloads = encode_embedding_payloads(vectors, "vec_id", encoding_format=encoding_format)
    responses = payloads.withColumn("payload", F.concat(F.lit('{"data":['), "payload", F.lit("]}")))
    return _elements(decode_embedding_payloads(responses).filter("size_ok"), "embedding")


D_SQL = hashed_sql("d", "doc_id", "documents")


@query(f"""
WITH {D_SQL}
SELECT doc_id, pos, round(vec[pos + 1], 6) AS value FROM (SELECT doc_id, vec, unnest(range(64)) AS pos FROM d)
""")
def hash_embed(spark, folder):
    """Hashed vectors of whole documents, one row per value."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vectors = embedding.hash_embed(documents, "text", dimensions=DIMENSIONS)
    return _exploded(vectors, "doc_id", "embedding")
