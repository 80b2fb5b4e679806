import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import ivf, knn
from docquarry.operators.embedding import embed, hash_embed
from docquarry.operators.knn import knn_exact
from docquarry.params import IvfParams

RNG = np.random.default_rng(3)
VECTORS = RNG.normal(size=(400, 8)).round(2)
VECTORS[100:200] = VECTORS[0]  # many equal copies: ties go by id
VECTORS[7] = 0.0
QUERIES = np.vstack([RNG.normal(size=(11, 8)).round(2), VECTORS[0], np.zeros(8)])


def brute(metric, k, keep=lambda i: True):
    hits = []
    for q, query in enumerate(QUERIES):
        scored = []
        for i, v in enumerate(VECTORS):
            if not keep(i):
                continue
            if metric == "l2":
                score = np.sqrt(((v - query) ** 2).sum())
            else:
                score = v @ query
                size = np.linalg.norm(v) * np.linalg.norm(query)
                if metric == "cosine":
                    score = score / size if size else 0.0
            scored.append((round(float(score), 9) + 0.0, i))
        scored.sort(key=lambda s: (s[0] if metric == "l2" else -s[0], s[1]))
        hits += [(q, r, i, round(s, 6) + 0.0) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(hits)


@pytest.fixture(scope="module")
def data(spark):
    vectors = spark.createDataFrame(
        [(i, v.tolist(), i % 3) for i, v in enumerate(VECTORS)], "chunk_id long, embedding array<double>, label int"
    ).repartition(5)
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(QUERIES)], "query_id long, query_vector array<double>")
    return queries, vectors


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6) + 0.0) for r in df.collect())


@pytest.mark.parametrize("metric", knn.METRICS)
def test_scan_and_blocks_equal_brute_force(data, metric, monkeypatch):
    queries, vectors = data
    want = brute(metric, 5)
    assert found(knn_exact(queries, vectors, 5, metric)) == want
    monkeypatch.setattr(knn, "BROADCAST_VALUES", 8)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(knn.block_search, "__defaults__", (4, 50))
    assert found(knn_exact(queries, vectors, 5, metric)) == want


def test_filter_before_scoring(data):
    queries, vectors = data
    got = knn_exact(queries, vectors, 3, where=vectors.label == 1)
    assert found(got) == brute("cosine", 3, lambda i: i % 3 == 1)


def test_edges(data):
    queries, vectors = data
    assert knn_exact(queries.limit(0), vectors, 3).count() == 0
    assert knn_exact(queries, vectors.limit(0), 3).count() == 0
    assert knn_exact(queries, vectors.limit(2), 5).count() == 2 * len(QUERIES)
    with pytest.raises(ValueError):
        knn_exact(queries, vectors, metric="manhattan")


@pytest.fixture(scope="module")
def index(data, tmp_path_factory):
    return ivf.build_ivf(data[1], str(tmp_path_factory.mktemp("ivf")), params=IvfParams(nlist=6))


def test_ivf_keeps_every_row_and_full_probe_is_exact(data, index, monkeypatch):
    queries, vectors = data
    assert index.rows.count() == len(VECTORS)
    assert len(index.centroids) == 6 and index.params == IvfParams("cosine", 6, 6)
    want = brute("cosine", 4)
    assert found(ivf.knn_ivf(queries, index, 4, nprobe=6)) == want
    monkeypatch.setattr(knn, "BROADCAST_VALUES", 8)
    monkeypatch.setattr(knn.block_search, "__defaults__", (4, 30))
    assert found(ivf.knn_ivf(queries, index, 4, nprobe=6)) == want


def test_ivf_few_probes(data, index, monkeypatch):
    queries, vectors = data
    few = ivf.knn_ivf(queries, index, 4, nprobe=2)
    exact = knn_exact(queries, vectors, 4)
    shares = [r.recall for r in ivf.recall(few, exact, "chunk_id").collect()]
    assert len(shares) == len(QUERIES) and all(0 <= s <= 1 for s in shares)
    assert sum(shares) / len(shares) > 0.5
    got = found(few)
    monkeypatch.setattr(knn, "BROADCAST_VALUES", 8)
    assert found(ivf.knn_ivf(queries, index, 4, nprobe=2)) == got


def test_every_row_is_clustered_and_the_number_of_cells_is_the_callers(spark, tmp_path):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(VECTORS[200:260])], "chunk_id long, embedding array<double>")
    assert len(ivf.train_centroids(vectors, "embedding", 20)) == 20
    assert len(ivf.train_centroids(vectors, "embedding", 1000)) <= 60
    index = ivf.build_ivf(vectors, str(tmp_path / "ivf"), params=IvfParams(nlist=20))
    assert index.rows.count() == 60 and index.rows.select("cell").distinct().count() > 10


def test_null_vectors_are_no_neighbours(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, None), (2, [1.0, 0.1])], "query_id long, query_vector array<double>")
    want = [(2, 1, 1), (2, 2, 3)]
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in knn_exact(queries, vectors, 3).collect()) == want
    index = ivf.build_ivf(vectors, str(tmp_path / "ivf"), params=IvfParams(nlist=2, nprobe=2))
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in ivf.knn_ivf(queries, index, 3).collect()) == want


def test_hash_embed_is_unit_and_empty_is_zero(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, content string")
    got = {r.id: np.array(r.embedding) for r in hash_embed(df, dimensions=16).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1)
    assert sorted(set(got[1].round(6))) in ([0.0, 0.447214, 0.894427], [0.0, 1.0])
    assert got[2].tolist() == [0.0] * 16


def test_plug_in_encoder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, "a")], "id int, content string").repartition(2)

    def encoder():
        return lambda texts: np.array([[3.0 * len(t), 4.0 * len(t), 0.0] for t in texts])

    got = {r.id: [round(x, 4) for x in r.embedding] for r in embed(df, encoder).collect()}
    assert got == {1: [0.6, 0.8, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.6, 0.8, 0.0]}
    cut = {len(r.embedding) for r in embed(df, encoder, instruction="I", dimensions=2).collect()}
    assert cut == {2}


# --- exact stopping and partitions of the cluster index


def clustered(seed, n, groups=12, width=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, width)) * 3
    return centers[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.15


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    points = np.concatenate([clustered(5, 400), np.zeros((3, 8)), clustered(5, 20)])
    rows = [(i, v.tolist(), f"0{i % 3}") for i, v in enumerate(points)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, collection string")
    asked = np.concatenate([clustered(5, 12), np.random.default_rng(6).normal(size=(6, 8)), np.zeros((1, 8))])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, query_vector array<double>")
    indexes = {
        metric: ivf.build_ivf(vectors, str(tmp_path_factory.mktemp(metric)), params=IvfParams(metric, 24, 2), partition_by=("collection",))
        for metric in ("cosine", "ip", "l2")
    }
    return vectors, queries, indexes


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("few", [True, False])
def test_exact_stopping_equals_a_full_scan(stored, metric, few, monkeypatch):
    vectors, queries, indexes = stored
    if not few:
        monkeypatch.setattr(knn, "BROADCAST_VALUES", 8)
        monkeypatch.setattr(knn.block_search, "__defaults__", (4, 50))
    index = indexes[metric]
    assert found(ivf.knn_ivf(queries, index, 5, exact=True)) == found(knn_exact(queries, vectors, 5, metric))
    one = vectors.filter("collection = '01' AND chunk_id % 5 > 0")
    part = ivf.knn_ivf(queries, index, 5, exact=True, part=F.col("collection") == "01", where=F.col("chunk_id") % 5 > 0)
    assert found(part) == found(knn_exact(queries, one, 5, metric))
    assert ivf.knn_ivf(queries, index, 5, exact=True, part=F.col("collection") == "none").count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_far_cells_are_not_read(stored, few, monkeypatch):
    _, queries, indexes = stored
    if not few:
        monkeypatch.setattr(knn, "BROADCAST_VALUES", 8)
    near = queries.filter("query_id < 12")
    effort = {r.query_id: r.cells for r in ivf.probe_ivf(near, indexes["cosine"], 3, exact=True).effort.collect()}
    assert len(effort) == 12 and all(2 <= n < 24 for n in effort.values()) and sum(effort.values()) < 12 * 16
    fixed = ivf.probe_ivf(near, indexes["cosine"], 3).effort.collect()
    assert {r.cells for r in fixed} == {2}


def test_both_levels_of_folders_are_pruned(stored):
    _, queries, indexes = stored
    hits = ivf.knn_ivf(queries.filter("query_id < 3"), indexes["cosine"], 3, nprobe=2, part=F.col("collection") == "01")
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "collection" in filters and "cell" in filters.split("collection", 1)[1]
    assert indexes["cosine"].rows.schema["collection"].dataType.simpleString() == "string"
    assert {r.collection for r in indexes["cosine"].rows.select("collection").distinct().collect()} == {"00", "01", "02"}


def test_tuned_probes_reach_the_share_asked_for(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 6)))], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))], "query_id long, query_vector array<double>")
    index = ivf.build_ivf(vectors, str(tmp_path / "ivf"), params=IvfParams(nlist=40, nprobe=1))
    tuned = ivf.tune_nprobe(asked.filter("query_id < 30"), index, 5, 0.9)
    assert 1 < tuned.params.nprobe < 40
    held = asked.filter("query_id >= 30")
    shares = [r.recall for r in ivf.recall(ivf.knn_ivf(held, tuned, 5), knn_exact(held, vectors, 5), "chunk_id").collect()]
    poor = [r.recall for r in ivf.recall(ivf.knn_ivf(held, index, 5), knn_exact(held, vectors, 5), "chunk_id").collect()]
    assert np.mean(shares) > 0.85 > np.mean(poor)


def test_vectors_of_a_udf_are_computed_once(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "chunk_id long, content string").repartition(3)
    embedded = embed(texts, lambda: lambda batch: np.array([[1.0, len(t)] for t in batch]))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    hits = knn_exact(queries, embedded, 2)
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1
