"""Rerank, fusion, context and prompts on top of the two searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.base import query, sql_tokens, table
from docquarry.catalog.lexical import BM25_SQL, TOKENS_SQL, benchmark_queries, bm25_over, document_index, tidy
from docquarry.catalog.vectors import D_SQL, DIMENSIONS, Q_SQL, query_vectors
from docquarry.functions.text import query_prompt, rerank_prompt
from docquarry.operators import fusion
from docquarry.operators.embedding import hash_embed
from docquarry.operators.generation import generate
from docquarry.operators.ivf import build_ivf
from docquarry.operators.knn import knn_exact
from docquarry.operators.lexical import bm25_search, write_index
from docquarry.operators.rerank import rerank
from docquarry.params import IvfParams
from docquarry.plans import retrieve as plan
from docquarry.session import materialise, scratch_path, spread

RERANK_SQL = f"""
pairs AS (SELECT query_id, doc_id, rank - 1 AS index, b.text AS query, d.text AS document
    FROM lexical JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
sets AS (SELECT *, list_distinct({sql_tokens('query')}) AS a, list_distinct({sql_tokens('document')}) AS b FROM pairs),
overlap AS (SELECT query_id, doc_id, index,
    round(len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS relevance_score
    FROM sets)
"""


def candidates(spark, folder):
    """Lexical hits with both texts; ``index`` is the position in the hit list."""
    hits = bm25_search(benchmark_queries(spark, folder), document_index(spark, folder))
    return (
        hits.join(table(spark, folder, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")
        .join(benchmark_queries(spark, folder).withColumnRenamed("text", "query"), "query_id")
        .select("query_id", "doc_id", (F.col("rank") - 1).alias("index"), "query", "document")
    )


def ranked(df):
    return df.select(
        "query_id", "doc_id", F.col("index").cast("long").alias("index"), "relevance_score", F.col("rank").cast("long").alias("rank")
    )


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}, {RERANK_SQL}
SELECT query_id, doc_id, index, relevance_score,
    row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, index) AS rank
FROM overlap
""")
def rerank_overlap(spark, folder):
    return ranked(rerank(candidates(spark, folder), max_candidates=10))


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}, {RERANK_SQL}
SELECT query_id, doc_id, index, relevance_score,
    row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, index) AS rank
FROM overlap QUALIFY rank <= 3
""")
def rerank_topn(spark, folder):
    return ranked(rerank(candidates(spark, folder), top_n=3))


VECTOR_SQL = f"""
{Q_SQL}, {D_SQL},
vscored AS (SELECT item_id AS query_id, doc_id, round(list_cosine_similarity(q.vec, d.vec), 9) AS score FROM q, d),
vector AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM vscored QUALIFY rank <= 10)
"""
FUSED_SQL = """
fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id,
    coalesce(l.rank, 0) AS lexical_rank, coalesce(v.rank, 0) AS vector_rank,
    round(coalesce(1 / (60 + l.rank)::double, 0) + coalesce(1 / (60 + v.rank)::double, 0), 9) AS score
    FROM lexical l FULL JOIN vector v ON l.query_id = v.query_id AND l.doc_id = v.doc_id)
"""


def document_vectors(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return hash_embed(documents, "text", dimensions=DIMENSIONS)


@query(f"WITH {VECTOR_SQL} SELECT query_id, rank, doc_id, score FROM vector")
def knn_documents(spark, folder):
    """Benchmark texts against whole documents, both through the built-in encoder."""
    vectors = document_vectors(spark, folder).select("doc_id", "embedding")
    return tidy(knn_exact(query_vectors(spark, folder), vectors, 10, id_col="doc_id"))


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}, {VECTOR_SQL}, {FUSED_SQL}
SELECT query_id, doc_id, lexical_rank, vector_rank, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM fused QUALIFY rank <= 10
""")
def hybrid_rrf(spark, folder):
    lexical = bm25_search(benchmark_queries(spark, folder), document_index(spark, folder))
    vectors = document_vectors(spark, folder).select("doc_id", "embedding")
    vector = knn_exact(query_vectors(spark, folder), vectors, 10, id_col="doc_id")
    fused = fusion.fuse_rrf(lexical, vector, "doc_id", top_n=10)
    # 0 stands for "not in this list".
    return fused.select(
        "query_id", "doc_id", "score",
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("rank", "lexical_rank", "vector_rank")],
    )


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}
SELECT query_id, count(*) AS n_chunks, string_agg(text, chr(10) ORDER BY rank) AS context
FROM lexical JOIN documents USING (doc_id) GROUP BY query_id
""")
def context_assembly(spark, folder):
    """Texts of the ten hits of every query in rank order."""
    hits = bm25_search(benchmark_queries(spark, folder), document_index(spark, folder))
    texts = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    context = fusion.assemble_context(hits.join(texts, "doc_id"), 10)
    return context.withColumn("n_chunks", F.col("n_chunks").cast("long"))


@query(f"""
WITH {TOKENS_SQL}, {BM25_SQL}, {VECTOR_SQL}, {FUSED_SQL},
first AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM fused QUALIFY rank <= 20),
rpairs AS (SELECT f.query_id, f.doc_id, f.rank - 1 AS index, b.text AS query, d.text AS document
    FROM first f JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
rsets AS (SELECT *, list_distinct({sql_tokens('query')}) AS a, list_distinct({sql_tokens('document')}) AS b FROM rpairs),
best AS (SELECT query_id, doc_id, document,
    round(len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS score, index
    FROM rsets)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index) AS rank, doc_id, score,
    document AS content
FROM best QUALIFY rank <= 10
""")
def retrieve(spark, folder):
    """Both searches, fusion and rerank over stored documents, index and vectors."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"))
    vectors = materialise(hash_embed(documents, "text", dimensions=DIMENSIONS), "document-vectors")
    queries = benchmark_queries(spark, folder).join(query_vectors(spark, folder), "query_id")
    return tidy(plan.retrieve(queries, index, vectors.withColumnRenamed("text", "content"), fuzzy=False))


_EN = "SELECT * FROM documents WHERE lang = 'en'"


@query(f"""
WITH {bm25_over(_EN)}, {VECTOR_SQL.replace('FROM documents', 'FROM (' + _EN + ')')}, {FUSED_SQL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, source, score, text AS content
FROM fused JOIN documents USING (doc_id) QUALIFY rank <= 10
""")
def retrieve_filtered(spark, folder):
    """Both searches restricted to one language, fused; nothing of other languages is scored, counted or returned."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"), keep=("lang",), partition_by=("lang",))
    vectors = materialise(hash_embed(documents, "text", dimensions=DIMENSIONS), "document-vectors")
    queries = benchmark_queries(spark, folder).join(query_vectors(spark, folder), "query_id")
    hits = plan.retrieve(
        queries, index, vectors.withColumnRenamed("text", "content"), reranked=False, fuzzy=False,
        where=F.col("lang") == "en", fields=("source",),
    )
    return tidy(hits).select("query_id", "rank", "doc_id", "source", "score", "content")


@query(f"""
WITH {bm25_over(_EN)}, {VECTOR_SQL.replace('FROM documents', 'FROM (' + _EN + ')')}, {FUSED_SQL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, source, score, text AS content
FROM fused JOIN documents USING (doc_id) QUALIFY rank <= 10
""")
def retrieve_cells(spark, folder):
    """The same with a cluster index that is partitioned by language: the vector half reads the cells of one language."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"))
    index = write_index(documents, "doc_id", "text", scratch_path(spark, "text-index"), keep=("lang",), partition_by=("lang",))
    vectors = materialise(hash_embed(documents, "text", dimensions=DIMENSIONS), "document-vectors")
    cells = build_ivf(
        vectors.select("doc_id", "embedding", "lang"), scratch_path(spark, "ivf"), "doc_id", params=IvfParams(nlist=32), partition_by=("lang",)
    )
    queries = benchmark_queries(spark, folder).join(query_vectors(spark, folder), "query_id")
    hits = plan.retrieve(
        queries, index, vectors.withColumnRenamed("text", "content"), reranked=False, fuzzy=False, cells=cells, part=F.col("lang") == "en",
        fields=("source",),
    )
    return tidy(hits).select("query_id", "rank", "doc_id", "source", "score", "content")


@query("""
SELECT conv_id, turn // 2 AS piece, count(*) AS n_turns,
    string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt
FROM conversations GROUP BY ALL
""")
def chat_prompt(spark, folder):
    prompts = fusion.chat_prompt(table(spark, folder, "conversations"), piece_turns=2)
    return prompts.withColumn("n_turns", F.col("n_turns").cast("long"))


@query("""
SELECT conv_id, turn,
    '<Instruct>: ' || (CASE WHEN role = 'user' THEN 'Given a web search query, retrieve relevant passages that answer the query'
        ELSE role END) || chr(10) || '<Query>: ' || role || chr(10) || '<Document>: ' || text AS pair_prompt,
    CASE WHEN role = 'user' THEN text ELSE 'Instruct: ' || role || chr(10) || 'Query: ' || text END AS query_prompt
FROM conversations
""")
def prompt_templates(spark, folder):
    """Pair and query templates; an empty instruction takes the default or leaves the text alone."""
    instruction = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", rerank_prompt("role", "text", instruction).alias("pair_prompt"),
        query_prompt("text", instruction).alias("query_prompt"),
    )


@query("""
SELECT conv_id, turn, CASE WHEN text LIKE '%e%e%e%e%e%' THEN NULL ELSE upper(substr(text, 1, 30)) END AS response,
    CASE WHEN text LIKE '%e%e%e%e%e%' THEN 'ValueError: refused' END AS error
FROM conversations
""")
def generate_answers(spark, folder):
    """Batches of turns sent to a callable that refuses some of them: the others of the batch have their answer."""

    def generator():
        def answer(prompts, temperature):
            if any(p.count("e") >= 5 for p in prompts):
                raise ValueError("refused")
            return [p[:30].upper() for p in prompts]

        return answer

    turns = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"))
    return generate(turns, generator, "text", error="error", budget=256).drop("text")
