import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators.embedding import hash_embed
from docquarry.operators.fusion import assemble_context, chat_prompt, fuse_rrf, history_prompt
from docquarry.operators.generation import generate
from docquarry.operators.ivf import build_ivf
from docquarry.operators.lexical import write_index
from docquarry.operators.rerank import model_scorer, pair_documents, rerank
from docquarry.params import IvfParams
from docquarry.plans.retrieve import retrieve, retrieve_context


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(
        [(1, "red fox", ["blue sky", "a red fox", "red", "fox red"], 3), (2, "x", ["x", "x"], None), (3, "x", ["x"], 0), (4, "x", ["y"], 9)],
        "query_id int, query string, documents array<string>, top_n int",
    )


def order(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r["index"])
    return got


def test_rerank_order_ties_and_top_n(requests):
    pairs = pair_documents(requests)
    assert order(rerank(pairs)) == {1: [3, 1, 2, 0], 2: [0, 1], 3: [0], 4: [0]}
    assert order(rerank(pairs, top_n=2)) == {1: [3, 1], 2: [0, 1], 3: [0], 4: [0]}
    assert order(rerank(pairs, top_n=0)) == {}
    # Per-request number: null keeps all, 0 none, more than there are keeps all.
    assert order(rerank(pairs, top_n="top_n")) == {1: [3, 1, 2], 2: [0, 1], 4: [0]}


def test_plug_in_scorer(requests):
    scorer = lambda: lambda q, d: np.array([len(x) for x in d])
    assert order(rerank(pair_documents(requests), model_scorer(scorer)))[1] == [1, 0, 3, 2]


def test_fusion_equals_full_outer_join(spark, rows):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "query_id int, rank int, id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z")], "query_id int, rank int, id string")
    got = rows(fuse_rrf(a, b, "id"), "query_id", "id", "lexical_rank", "vector_rank", "score")
    r = lambda *ranks: round(sum(1 / (60 + k) for k in ranks), 9)
    assert got == [(1, "x", 1, None, r(1)), (1, "y", 2, 1, r(2, 1)), (1, "z", None, 2, r(2)), (2, "x", 1, None, r(1))]
    assert rows(fuse_rrf(a, b, "id", top_n=1), "query_id", "id", "rank") == [(1, "y", 1), (2, "x", 1)]


def test_context_is_in_rank_order(spark, rows):
    hits = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "z")], "query_id int, rank int, content string")
    assert rows(assemble_context(hits, 2)) == [(1, 2, "a\nb"), (2, 1, "z")]


def test_long_conversations_continue_in_pieces(spark, rows):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(5)], "conv_id int, turn int, role string, text string")
    assert rows(chat_prompt(turns, piece_turns=2)) == [
        (1, 0, 2, "user: 0\nuser: 1"), (1, 1, 2, "user: 2\nuser: 3"), (1, 2, 1, "user: 4")
    ]
    assert len(rows(chat_prompt(turns, 1000))) == 1


def test_history_and_generation(spark):
    df = spark.createDataFrame([(["a", "b"], "q")], "h array<string>, q string").select(history_prompt("h", "q").alias("prompt"))
    assert df.first()[0] == "a\nb\nq"
    seen = generate(df, lambda: lambda prompts, t: [f"{t}:{p[-1]}" for p in prompts]).first()
    assert seen.response == "0.001:q"


def test_retrieve_end_to_end(spark, tmp_path):
    texts = ["the quick brown fox", "lazy dogs sleep", "a fox and a dog", "nothing of note"]
    chunks = hash_embed(
        spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), dimensions=32
    )
    index = write_index(chunks, "chunk_id", "content", str(tmp_path / "index"))
    queries = hash_embed(
        spark.createDataFrame([(1, "brown fox"), (2, "dogs")], "query_id long, text string"), "text", "query_vector", 32
    )
    best = {r.query_id: r.chunk_id for r in retrieve(queries, index, chunks, k=3, top_n=1).collect()}
    assert best == {1: 0, 2: 1}
    plain = retrieve(queries, index, chunks, k=3, top_n=2, reranked=False)
    assert plain.groupBy("query_id").count().filter("count = 2").count() == 2
    # A better hit outside the restriction is neither scored nor returned, by either half.
    kept = write_index(chunks.withColumn("base", chunks.chunk_id % 2), "chunk_id", "content", str(tmp_path / "kept"), keep=("base",))
    part = retrieve(
        queries, kept, chunks.withColumn("base", chunks.chunk_id % 2), k=3, top_n=3, where=F.col("base") == 1, fields=("base",)
    )
    assert {r.chunk_id for r in part.collect()} <= {1, 3} and {r.base for r in part.collect()} == {1}
    cells = build_ivf(chunks, str(tmp_path / "cells"), params=IvfParams(nlist=4, nprobe=4))
    clustered = {r.query_id: r.chunk_id for r in retrieve(queries, index, chunks, k=3, top_n=1, cells=cells).collect()}
    assert clustered == best
    contexts = {r.query_id: r.context for r in retrieve_context(queries, index, chunks, top_n=1, k=3).collect()}
    assert contexts == {1: texts[0], 2: texts[1]}


def test_generation_keeps_order_and_fails_by_row(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)) + f" {i}") for i in range(40)] + [(40, None), (41, ""), (42, "slow")]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(3)

    def generator():
        import time

        def answer(prompts, temperature):
            assert len(prompts) * max(len(p.split()) for p in prompts) <= 24 or len(prompts) == 1
            if "slow" in prompts:
                time.sleep(3)
            if any(p.endswith(" 7") or p.endswith(" 20") for p in prompts):
                raise ValueError("no")
            return [p[::-1] for p in prompts]

        return answer

    got = {r.id: (r.response, r.error) for r in generate(df, generator, error="error", budget=24, timeout=1.0).collect()}
    want = {i: (None, "ValueError: no") if i in (7, 20) else (p[::-1], None) for i, p in rows if p is not None}
    assert got == {**want, 40: (None, None), 42: (None, "timeout")}
    with pytest.raises(Exception, match="ValueError: no"):
        generate(df, generator, budget=24).collect()
