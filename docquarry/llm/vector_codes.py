"""Product codes of vectors: codebooks by exact integer k-means, nearest entries by a geometric near-neighbour tree.

Every component becomes an integer (``floor(scale * x)``); vectors are cut into equal consecutive parts, each with a
codebook of its own. In every round all parts of all vectors are assigned to their nearest entries and each entry
moves to the rounded-down mean of its parts; only sums per entry leave the tasks.

The nearest entry is found by a tree over the entries (GNAT): a node has a few split points, every other entry belongs
to the nearest of them, and for each pair of split point and child the range of distances from the one to all
entries of the other is kept. A query that measures its distance to a split point drops every child whose range
puts all its entries strictly farther than the best entry so far. Ranges and distances are roots of integers, rounded
outwards; what is left is compared by integers, ties to the lower index, so the result is that of a full scan.

Defined results: a row is dropped when its vector is null or empty, or holds a null, a NaN, an infinite component or one
of 2^15 and more (squared distances would not fit a long), or when its length is not that of the vector with the
smallest id. Lengths that the parts do not divide are filled up with zeros. A null id comes first; rows with equal ids
are ordered by their vectors. With fewer vectors than entries the codebooks are shorter. Labels that are null count
as equal. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.session import broadcast_if_small, materialise

LARGEST = float(1 << 15)
CHUNK = 4096


@dataclass(frozen=True)
class VectorCode:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    splits: int = 4


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(-1)


def _below(squared: np.ndarray) -> np.ndarray:
    """A root rounded down, by one too much rather than too little."""
    return np.maximum(np.floor(np.sqrt(squared.astype(np.float64))) - 1, 0).astype(np.int64)


def _above(squared: np.ndarray) -> np.ndarray:
    return (np.ceil(np.sqrt(squared.astype(np.float64))) + 1).astype(np.int64)


class Gnat:
    """A tree over the rows of ``points`` (integers). ``measured`` counts the distances of all searches."""

    def __init__(self, points: np.ndarray, splits: int = 4):
        self.points, self.splits, self.measured = points, splits, 0
        self.root = self._node(np.arange(len(points)))

    def _node(self, members: np.ndarray):
        if not len(members):
            return None
        # Split points far from one another: each next one is the farthest from those taken.
        taken = [members[0]]
        gap = _squared(self.points[members], self.points[members[0]])
        while len(taken) < min(self.splits, len(members)):
            taken.append(members[int(np.argmax(np.where(np.isin(members, taken), -1, gap)))])
            gap = np.minimum(gap, _squared(self.points[members], self.points[taken[-1]]))
        taken = np.array(taken)
        rest = members[~np.isin(members, taken)]
        owner = _squared(self.points[rest][:, None], self.points[taken][None]).argmin(1)
        low = np.zeros((len(taken), len(taken)), np.int64)
        high = low.copy()
        children = []
        for j, split in enumerate(taken):
            child = rest[owner == j]
            for i, other in enumerate(taken):
                ranged = _squared(self.points[np.append(child, split)], self.points[other])
                low[i, j], high[i, j] = _below(ranged.min()), _above(ranged.max())
            children.append(self._node(child))
        return taken, low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point of each query, of equally near ones the lowest, and the squared distance."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.points))
        todo = [(self.root, np.arange(len(queries)))] if self.root else []
        while todo:
            (taken, low, high, children), rows = todo.pop()
            alive = np.ones((len(rows), len(taken)), bool)
            for i, split in enumerate(taken):
                here = np.flatnonzero(alive[:, i])
                if not len(here):
                    continue
                at = rows[here]
                squared = _squared(queries[at], self.points[split])
                self.measured += len(at)
                better = (squared < best[at]) | ((squared == best[at]) & (split < index[at]))
                best[at[better]], index[at[better]] = squared[better], split
                inner, outer, reach = _below(squared)[:, None], _above(squared)[:, None], _above(best[at])[:, None]
                far = (inner - reach > high[i]) | (outer + reach < low[i])
                alive[here] &= ~far
            for j, child in enumerate(children):
                if child is not None and alive[:, j].any():
                    todo.append((child, rows[alive[:, j]]))
        return index, best


def _integers(vectors: pa.Array, length: int, code: VectorCode) -> np.ndarray:
    """Rows x parts x width."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * code.scale).astype(np.int64).reshape(len(vectors), length)
    width = -(-length // code.parts)
    return np.pad(whole, ((0, 0), (0, width * code.parts - length))).reshape(len(vectors), code.parts, width)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    inside = F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))  # NaN is larger than all numbers
    return rows.filter((F.size("v") > 0) & inside)


def train(rows: DataFrame, code: VectorCode) -> tuple[np.ndarray, int]:
    """Codebooks (parts x entries x width) and the vectors' length; ``rows`` has id and v."""
    seeds = rows.select("id", "v").orderBy("id", "v").limit(code.entries).collect()
    if not seeds:
        return np.zeros((code.parts, 0, 0), np.int64), 0
    length = len(seeds[0].v)
    usable = rows.filter(F.size("v") == length)
    if any(len(s.v) != length for s in seeds):
        seeds = usable.select("id", "v").orderBy("id", "v").limit(code.entries).collect()
    books = _integers(pa.array([s.v for s in seeds], pa.list_(pa.float64())), length, code).transpose(1, 0, 2).copy()
    for _ in range(code.rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def sums(batches, shared=shared):
            books = shared.value
            trees = [Gnat(book, code.splits) for book in books]
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    whole = _integers(batch.column(0).slice(at, CHUNK), length, code)
                    for p, tree in enumerate(trees):
                        entry, _ = tree.nearest(whole[:, p])
                        np.add.at(total[p], entry, whole[:, p])
                        count[p] += np.bincount(entry, minlength=books.shape[1])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(total[part, entry]), pa.list_(pa.int64())), pa.array(count[part, entry], pa.int64())],
                ["part", "entry", "total", "n"],
            )

        partial = usable.select("v").mapInArrow(sums, "part int, entry int, total array<bigint>, n bigint")
        each = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        moved = each.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # one row per codebook component
        for part, entry, at, x, n in moved:
            books[part, entry, at] = x // n
    return books, length


def code_vectors(
    vectors: DataFrame, code: VectorCode = VectorCode(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per kept row: id, ``code`` (array of entry indexes by part), ``error``, ``label_error`` and ``codebooks_sha256``."""
    rows = _usable(vectors, id_col, vector_col, label_col)
    books, length = train(rows, code)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf(T.StructType([T.StructField("code", T.ArrayType(T.IntegerType(), False)), T.StructField("error", T.LongType())]))
    def assign(batch: pa.Array) -> pa.Array:
        trees = [Gnat(book, code.splits) for book in shared.value]
        entries, errors = [], []
        for at in range(0, len(batch), CHUNK):
            whole = _integers(batch.slice(at, CHUNK), length, code)
            found = [tree.nearest(whole[:, p]) for p, tree in enumerate(trees)]
            entries.append(np.stack([entry for entry, _ in found], 1))
            errors.append(sum(gap for _, gap in found))
        flat = np.concatenate([np.zeros((0, code.parts), np.int64), *entries]).astype(np.int32)
        offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * code.parts)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), pa.array(np.concatenate([np.zeros(0, np.int64), *errors]))], ["code", "error"]
        )

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    usable = rows.filter(F.size("v") == length)
    coded = materialise(usable.select("id", "label", assign("v").alias("c")).select("id", "label", "c.*"), "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(broadcast_if_small(labels), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
