"""Product codes: the tree against a full scan, the job against plain Python, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from docquarry.llm.queries import op13_gnat_codes
from docquarry.llm.vector_codes import Gnat, VectorCode, code_vectors


@pytest.mark.parametrize("spread", [2, 9, 300, 1 << 27])
@pytest.mark.parametrize("width", [1, 3, 8])
def test_tree_equals_full_scan_with_ties(spread, width):
    rng = np.random.default_rng(spread + width)
    for n in (1, 2, 5, 16, 70):
        points, queries = (rng.integers(-spread, spread + 1, (k, width)) for k in (n, 300))
        queries[:n] = points
        index, squared = Gnat(points).nearest(queries)
        full = ((queries[:, None] - points[None]) ** 2).sum(-1)
        assert squared.tolist() == full.min(1).tolist() and index.tolist() == full.argmin(1).tolist()


def test_tree_leaves_out_distances():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (16, 4)) + 10_000 * k for k in range(4)])
    tree = Gnat(points)
    tree.nearest(points.repeat(20, 0))
    assert tree.measured < 0.6 * len(points) * 20 * len(points)


def plain(rows, parts, entries, rounds):
    kept = sorted(((i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            mine = [[] for _ in book]
            for c in cut:
                mine[nearest(c[p], book)[1]].append(c[p])
            new.append([[sum(col) // len(m) for col in zip(*m)] if m else y for m, y in zip(mine, book)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    return sorted(
        ((i, [e for _, e in f], err, sum(x for x, k in zip(errors, kept) if k[2] == label), digest)
         for (i, _, label), f, err in zip(kept, found, errors)), key=repr)


def got(frame):
    return sorted(((r[0], list(r[1]), *r[2:]) for r in frame.collect()), key=repr)


def test_job_equals_plain_python_on_odd_rows(spark):
    random.seed(3)
    rows = [(i, [random.choice([-1, 1]) * random.random() for _ in range(8)], random.choice([None, 1, 2])) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1], 1) for i in range(40)]  # repeated vectors
    rows += [(3, rows[9][1], 2), (300, None, 1), (301, [0.1] * 7 + [None], 1), (302, [0.1] * 7 + [math.nan], 1), (303, [math.inf] + [0.0] * 7, 1)]
    rows += [(304, [], 1), (None, rows[4][1], None)]
    code = VectorCode(parts=2, entries=5, rounds=3)
    schema = "vec_id bigint, embedding array<double>, label int"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    extra = frame.selectExpr("*", "'x' AS code", "1 AS error", "2 AS v", "3 AS id")
    assert got(code_vectors(extra, code)) == plain(rows, 2, 5, 3)
    assert code_vectors(frame.limit(0), code).collect() == []
    few = rows[:3]
    assert got(code_vectors(spark.createDataFrame(few, schema), code)) == plain(few, 2, 5, 3)


def test_lengths(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    rows = [(1, [0.5, 0.25, 1.0], 1), (2, [0.5, 0.25], 1), (3, [-0.5, 0.75, 1.0], None), (4, [40000.0, 0.0, 0.0], 1)]
    result = code_vectors(spark.createDataFrame(rows, schema), VectorCode(parts=2, entries=4, rounds=2))
    assert sorted((r.vec_id, r.error) for r in result.collect()) == [(1, 0), (3, 0)]  # another length and a huge component are dropped


def test_query_at_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = sorted(((i, "".join(f"{e:02x}" for e in c), *rest) for i, c, *rest in plain(rows, 8, 16, 6)), key=repr)
    assert sorted((tuple(r) for r in op13_gnat_codes(spark, folder).collect()), key=repr) == want
