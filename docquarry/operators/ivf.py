"""Cluster-bucketed vector index: build, probe, exact stopping, recall.

Vectors are stored by cell, the nearest centroid, and where the caller names partition columns (a collection), by
those first: a search inside one collection reads that collection's folders only. For every cell and partition a
table holds how far its vectors lie from the centroid (smallest and largest angle, distance and norm). From it follows the
best score that a cell can have for a query.

Two ways of stopping. With a fixed number of probes the nearest cells are read, and the share of the exact hits
depends on the data; ``tune_nprobe`` finds the number for a share asked for. With ``exact`` the cells are read in the
order of their best possible score, in rounds of growing size, until no unread cell can have a better hit than the
``k``-th found: the result is that of a full scan, and only the work depends on the data.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.vectors import as_doubles, norm
from docquarry.operators.common import top_k
from docquarry.operators.knn import (
    _matrix, _result_schema, _unit, best_pairs, block_search, bounded_rows, merge_pairs, pair_scores, rank_found,
)
from docquarry.params import VECTOR_TOP_K, IvfParams, read_params, write_params
from docquarry.session import materialise

# Every round of an exact search reads up to so many times the cells of the rounds before.
ROUND_GROWTH = 4
# Scores are rounded to nine digits and angles are roots of rounded products: a cell that misses by less is read.
SLACK = 1e-6
SPREAD = ("cell_angle", "cell_distance", "cell_norm")


@dataclass(frozen=True)
class IvfIndex:
    """``rows``: the vector table with ``cell``, stored partitioned; ``cells``: one row per partition and cell with its bounds."""

    rows: DataFrame
    cells: DataFrame
    centroids: np.ndarray
    params: IvfParams
    id_col: str
    vector_col: str
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class IvfHits:
    """``hits``: the ranked rows; ``effort``: per query the number of ``cells`` that were read for it."""

    hits: DataFrame
    effort: DataFrame


def train_centroids(vectors: DataFrame, vector_col: str, nlist: int, seed: int = 42) -> np.ndarray:
    """Unit centroids by distributed k-means with cosine distance over all vectors; at most ``nlist``."""
    usable = vectors.select(as_doubles(vector_col).alias("v")).filter(norm("v") > 0)
    total = usable.count()
    if not total:
        raise ValueError("no vector to cluster")
    model = KMeans(k=min(nlist, total), distanceMeasure="cosine", seed=seed, featuresCol="features").fit(
        usable.select(array_to_vector("v").alias("features"))
    )
    return _unit(np.array(model.clusterCenters()))


def assign_cells(vectors: DataFrame, centroids: np.ndarray, vector_col: str) -> DataFrame:
    """Adds ``cell``, the nearest centroid by cosine, and the row's angle and distance to it and its norm; no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cell int, cell_angle double, cell_distance double, cell_norm double")
    def nearest(batch: pd.Series) -> pd.DataFrame:
        centers = shared.value
        matrix = _matrix(batch, centers.shape[1])
        scores = _unit(matrix) @ centers.T
        cell = scores.argmax(axis=1)
        length = np.linalg.norm(matrix, axis=1)
        angle = pd.Series(np.arccos(np.clip(scores[np.arange(len(cell)), cell], -1, 1)), dtype=object)
        angle[length == 0] = None  # a zero vector has no angle
        distance = np.linalg.norm(matrix - centers[cell], axis=1)
        return pd.DataFrame({"cell": cell, "cell_angle": angle, "cell_distance": distance, "cell_norm": length})

    placed = vectors.withColumn("__place", nearest(F.col(vector_col)))
    return placed.select(*vectors.columns, "__place.*")


def build_ivf(
    vectors: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding",
    params: IvfParams = IvfParams(), seed: int = 42, partition_by: tuple[str, ...] = (),
) -> IvfIndex:
    """Train, assign and store the index under ``path``, by ``partition_by`` and cell.

    All partitions share the centroids. The rebalance hint lets Spark write a hot cell from several tasks and put
    small ones together.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col(vector_col).isNotNull())
    centroids = train_centroids(vectors, vector_col, params.nlist, seed)
    assigned = assign_cells(vectors, centroids, vector_col)
    folders = (*partition_by, "cell")
    assigned.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/rows")
    spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(assigned.schema.json(), list(partition_by))], "schema string, partition_by array<string>").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/layout")
    stored = spark.read.schema(assigned.schema).parquet(f"{path}/rows")
    bounds = [f(F.col(c)).alias(f"{c}_{end}") for c in SPREAD for end, f in (("low", F.min), ("high", F.max))]
    cells = stored.groupBy(*folders).agg(F.count("*").alias("n"), *bounds)
    cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    kept = IvfParams(params.metric, len(centroids), min(params.nprobe, len(centroids)))
    write_params(spark, kept, f"{path}/params")
    return open_ivf(spark, path, id_col, vector_col)


def open_ivf(spark: SparkSession, path: str, id_col: str = "chunk_id", vector_col: str = "embedding") -> IvfIndex:
    centers = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    layout = spark.read.parquet(f"{path}/layout").first()
    # The stored schema keeps the types of partition columns, which folder names do not.
    schema = T.StructType.fromJson(json.loads(layout.schema))
    return IvfIndex(
        spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), _matrix(centers["centroid"], 0),
        read_params(spark, IvfParams, f"{path}/params"), id_col, vector_col, tuple(layout.partition_by),
    )


@dataclass(frozen=True)
class _Bounds:
    """Per cell (by number) the number of vectors and the ranges of their angle, distance and norm."""

    n: np.ndarray
    angle: np.ndarray
    distance: np.ndarray
    norm: np.ndarray

    @staticmethod
    def of(index: IvfIndex, part: Column | None) -> _Bounds:
        """Of all partitions that satisfy ``part`` (a condition on partition columns); at most one row per cell is collected."""
        cells = index.cells if part is None else index.cells.filter(part)
        ends = [f(f"{c}_{end}").alias(f"{c}_{end}") for c in SPREAD for end, f in (("low", F.min), ("high", F.max))]
        rows = cells.groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect()
        count = np.zeros(len(index.centroids), np.int64)
        ranges = {c: np.full((2, len(index.centroids)), np.nan) for c in SPREAD}
        for r in rows:
            count[r.cell] = r.n
            for c in SPREAD:
                ranges[c][:, r.cell] = [np.nan if r[f"{c}_{e}"] is None else r[f"{c}_{e}"] for e in ("low", "high")]
        return _Bounds(count, *(ranges[c] for c in SPREAD))

    def best(self, queries: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
        """The best score (larger is better; distances negative) that a vector of each cell can have for each query."""
        unit, length = _unit(queries), np.linalg.norm(queries, axis=1)[:, None]
        if metric == "l2":
            far = np.sqrt(np.maximum((queries ** 2).sum(1)[:, None] - 2 * queries @ centroids.T + (centroids ** 2).sum(1), 0))
            best = -np.maximum(np.maximum(far - self.distance[1], self.distance[0] - far), 0)
        else:
            between = np.arccos(np.clip(unit @ centroids.T, -1, 1))
            angle = np.maximum(np.maximum(between - self.angle[1], self.angle[0] - between), 0)
            # A zero query or vector scores 0; a cell of zero vectors has no angles.
            best = np.where(np.isnan(angle), 0.0, np.where(length > 0, np.cos(angle), 0.0))
            if metric == "ip":
                best = length * np.where(best > 0, best * self.norm[1], best * self.norm[0])
            else:
                best = np.where(self.norm[0] == 0, np.maximum(best, 0), best)
        return np.where(self.n > 0, best, -math.inf)


@dataclass(frozen=True)
class _Prober:
    """Which cells a query reads next."""

    bounds: _Bounds
    centroids: np.ndarray
    metric: str
    exact: bool

    def cells(self, queries: np.ndarray, bar: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        """Per query the cells at places ``low`` to ``high`` of its order; in an exact search those that can reach ``bar``."""
        near = _unit(queries) @ self.centroids.T
        best = self.bounds.best(queries, self.centroids, self.metric)
        if not self.exact:
            order = np.argsort(np.where(np.isfinite(best), -near, math.inf), axis=1, kind="stable")[:, low:high]
            return [o[np.isfinite(b[o])] for o, b in zip(order, best)]
        # Many cells may hold an equal vector: of those the nearest first.
        order = np.lexsort((-near, -best), axis=1)[:, low:high]
        least = bar - SLACK * np.maximum(1, np.abs(np.where(np.isfinite(bar), bar, 0)))
        return [o[np.isfinite(b[o]) & (b[o] >= at)] for o, b, at in zip(order, best, least)]


def knn_ivf(
    queries: DataFrame, index: IvfIndex, k: int = VECTOR_TOP_K, nprobe: int | None = None,
    query_id: str = "query_id", query_vector: str = "query_vector",
    exact: bool = False, part: Column | None = None, where: Column | None = None,
) -> DataFrame:
    """Best ``k`` vectors of each query: ``(query_id, rank, <id>, score)``; see ``probe_ivf``."""
    return probe_ivf(queries, index, k, nprobe, query_id, query_vector, exact, part, where).hits


def probe_ivf(
    queries: DataFrame, index: IvfIndex, k: int = VECTOR_TOP_K, nprobe: int | None = None,
    query_id: str = "query_id", query_vector: str = "query_vector",
    exact: bool = False, part: Column | None = None, where: Column | None = None,
) -> IvfHits:
    """Best ``k`` vectors among the ``nprobe`` cells nearest to each query, or with ``exact`` among all vectors.

    ``part`` is a condition on the index's partition columns: other folders are not read, and bounds are those of the
    partitions alone. ``where`` is any condition on the rows. Both restrict before scoring.
    """
    metric, id_col, vector_col = index.params.metric, index.id_col, index.vector_col
    total = len(index.centroids)
    low, high = 0, min(nprobe or index.params.nprobe, total)
    prober = _Prober(_Bounds.of(index, part), index.centroids, metric, exact)
    rows = index.rows
    for condition in (part, where):
        rows = rows if condition is None else rows.filter(condition)
    rows = rows.select(id_col, vector_col, "cell")
    queries = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector")).filter("query_vector IS NOT NULL")
    known = bounded_rows(queries, "query_vector")
    search = _FewQueries(known, prober, rows, k, metric, index, queries) if known is not None else _ManyQueries(queries, prober, rows, k, metric, index)
    found, efforts = None, []
    while low < high:
        new = search.round(found, low, high)
        if new is None:
            break
        hits, effort = new
        efforts.append(effort)
        found = hits if found is None else found.union(hits)
        low, high = high, min(high * (ROUND_GROWTH + 1), total) if exact else high
        if low < high:
            order = F.asc("score") if metric == "l2" else F.desc("score")
            found = materialise(top_k(found, ["query_id"], [order, F.asc("id")], k).drop("rank"), "ivf-hits")
    if found is None:
        found = queries.sparkSession.createDataFrame([], _result_schema(queries, index.rows, "query_id", id_col))
    read = search.effort(efforts)
    return IvfHits(rank_found(found, k, metric, id_col), read)


def _bars(found: DataFrame, k: int, metric: str) -> DataFrame:
    """Per query with ``k`` hits the score (larger is better) that a further hit must reach."""
    worst = -F.max("score") if metric == "l2" else F.min("score")
    return found.groupBy("query_id").agg(F.count("*").alias("n"), worst.alias("bar")).filter(F.col("n") >= k).select("query_id", "bar")


class _FewQueries:
    """Queries whose matrix is broadcast: every round scans the cells that some query reads (partition pruning)."""

    def __init__(self, known, prober, rows, k, metric, index, queries):
        self.ids = known["query_id"].to_numpy()
        self.matrix = _matrix(known["query_vector"], index.centroids.shape[1])
        self.prober, self.rows, self.k, self.metric, self.id_col, self.vector_col = prober, rows, k, metric, index.id_col, index.vector_col
        self.schema = _result_schema(queries, index.rows, "query_id", index.id_col)
        self.id_type = queries.schema["query_id"].dataType
        self.context = queries.sparkSession

    def round(self, found, low, high):
        bar = np.full(len(self.ids), -math.inf)
        if found is not None:
            # One row per query, and there are few of them.
            reached = {r.query_id: r.bar for r in _bars(found, self.k, self.metric).collect()}
            bar = np.array([reached.get(q, -math.inf) for q in self.ids.tolist()], float)
        cells = self.prober.cells(self.matrix, bar, low, high) if len(self.ids) else []
        flat = np.concatenate([np.zeros(0, int), *cells])
        if not len(flat):
            return None
        asking = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        turn = np.argsort(flat, kind="stable")
        shared = self.context.sparkContext.broadcast((self.ids, self.matrix, flat[turn], asking[turn]))
        k, metric, id_col, vector_col = self.k, self.metric, self.id_col, self.vector_col

        def scan(batches):
            query_ids, matrix, of_cell, of_query = shared.value
            best = None
            for batch in batches:
                for cell, group in batch.groupby("cell", sort=False):
                    mine = of_query[np.searchsorted(of_cell, cell) : np.searchsorted(of_cell, cell, side="right")]
                    scores = pair_scores(_matrix(group[vector_col], matrix.shape[1]), matrix[mine], metric)
                    got = best_pairs(group[id_col], scores, query_ids[mine], k, metric != "l2")
                    best = got if best is None else merge_pairs([best, got], k, metric != "l2")
            if best is not None:
                yield best

        wanted = self.rows.filter(F.col("cell").isin(np.unique(flat).tolist()))
        return wanted.mapInPandas(scan, self.schema), np.array([len(c) for c in cells])

    def effort(self, efforts):
        total = sum(efforts) if efforts else np.zeros(len(self.ids), int)
        schema = T.StructType([T.StructField("query_id", self.id_type), T.StructField("cells", T.LongType())])
        return self.context.createDataFrame(list(zip(self.ids.tolist(), map(int, total))), schema)


class _ManyQueries:
    """Queries of any number: they are dealt to the cells they read, and blocks of a cell meet in one group."""

    def __init__(self, queries, prober, rows, k, metric, index):
        self.queries, self.rows, self.k, self.metric, self.index = queries, rows, k, metric, index
        shared = queries.sparkSession.sparkContext.broadcast(prober)

        @F.pandas_udf("array<int>")
        def cells(vectors: pd.Series, bar: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
            prober = shared.value
            matrix = _matrix(vectors, prober.centroids.shape[1])
            if not len(matrix):
                return pd.Series([], dtype=object)
            reach = bar.fillna(-math.inf).to_numpy(float)
            return pd.Series(prober.cells(matrix, reach, int(low.iloc[0]), int(high.iloc[0])), index=vectors.index)

        self.cells = cells

    def round(self, found, low, high):
        asking = self.queries.withColumn("bar", F.lit(None).cast("double"))
        if found is not None:
            asking = self.queries.join(_bars(found, self.k, self.metric), "query_id", "left")
        chosen = asking.select("query_id", "query_vector", F.explode(self.cells("query_vector", "bar", F.lit(low), F.lit(high))).alias("cell"))
        probing = materialise(chosen, "ivf-probes")
        if probing.isEmpty():
            return None
        hits = block_search(probing, self.rows, self.k, self.metric, "query_id", "query_vector", self.index.id_col, self.index.vector_col)
        return hits, probing.groupBy("query_id").agg(F.count("*").alias("cells"))

    def effort(self, efforts):
        read = self.queries.select("query_id", F.lit(0).cast("long").alias("cells"))
        for effort in efforts:
            read = read.union(effort)
        return read.groupBy("query_id").agg(F.sum("cells").alias("cells"))


def tune_nprobe(
    queries: DataFrame, index: IvfIndex, k: int = VECTOR_TOP_K, target: float = 0.9,
    query_id: str = "query_id", query_vector: str = "query_vector",
) -> IvfIndex:
    """The index with the smallest number of probes that finds the share ``target`` of the exact hits of ``queries``.

    ``queries`` is a bounded sample of the queries to come (its matrix must be fit for a broadcast), held out from those
    on which recall is reported. The exact hits come from an exact search; a hit is found when its cell is among
    those read.
    """
    known = bounded_rows(queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull()), query_vector)
    if known is None:
        raise ValueError("tune with a bounded sample of queries")
    hits = knn_ivf(queries, index, k, query_id=query_id, query_vector=query_vector, exact=True)
    cells = index.rows.select(index.id_col, "cell").join(F.broadcast(hits.select("query_id", index.id_col)), index.id_col).collect()
    if not cells:
        return index
    matrix = _matrix(known[query_vector], index.centroids.shape[1])
    order = _Prober(_Bounds.of(index, None), index.centroids, index.params.metric, False).cells(matrix, np.zeros(len(matrix)), 0, len(index.centroids))
    place = {q: {int(c): i for i, c in enumerate(o)} for q, o in zip(known[query_id].tolist(), order)}
    needed: dict = {}
    for r in cells:
        needed.setdefault(r.query_id, []).append(place[r.query_id][r.cell])
    at = np.arange(len(index.centroids))
    share = np.mean([(np.array(p)[:, None] <= at).mean(0) for p in needed.values()], axis=0)
    return replace(index, params=replace(index.params, nprobe=int(np.argmax(share >= min(target, share[-1]))) + 1))


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    hit = found.select("query_id", id_col, F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["query_id", id_col], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("expected"))
    )
