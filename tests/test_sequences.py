import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import geometry
from docquarry.operators import boxes, runs
from docquarry.operators.segments import Ordered


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; others are small."""
    rng = random.Random(5)
    keys = ["hot"] * 900 + [f"k{rng.randrange(30)}" for _ in range(200)]
    data = [(k, rng.randrange(10_000), i, rng.choice("aab-")) for i, k in enumerate(keys)]
    return data, spark.createDataFrame(data, "k string, t int, id int, s string").repartition(6)


def expected(data):
    groups = {}
    for row in sorted(data):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("bound", [10_000, 50])
def test_ordered_functions_do_not_depend_on_splitting(hot, bound):
    data, df = hot
    ordered = Ordered.of(df, ["k"], ["t", "id"], bound)
    assert ordered.split == (bound == 50)
    got = ordered.previous("s", "before").position("pos").running_sum("t", "total").result()
    assert "__segment" not in got.columns
    want = []
    for group in expected(data).values():
        total, before = 0, None
        for pos, (k, t, i, s) in enumerate(group):
            total += t
            want.append((k, t, i, s, before, pos, total))
            before = s
    assert sorted(map(tuple, got.select("k", "t", "id", "s", "before", "pos", "total").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("bound", [10_000, 50])
def test_runs_and_text(hot, bound):
    data, df = hot
    want = {}
    for k, group in expected(data).items():
        kept = [g[3] for a, g in zip([None, *group], group) if (a is None or a[3] != g[3]) and g[3] != "-"]
        want[k] = "".join(kept)
    kept = runs.collapse_runs(df, ["k"], ["t", "id"], "s", "-", bound)
    pieces = runs.decode_text(kept, ["k"], ["t", "id"], "s", piece_symbols=7, max_group_rows=bound)
    got = {}
    for r in pieces.orderBy("k", "piece").collect():
        assert r.n_symbols == len(r.text) <= 7
        got[r.k] = got.get(r.k, "") + r.text
    assert got == {k: t for k, t in want.items() if t}


def test_ctc_example(spark, rows):
    # 0 is blank; a run is broken by a blank, so "1 0 1" gives two symbols.
    steps = [(1, t, c, p) for t, (c, p) in enumerate([(0, 0.9), (1, 0.8), (1, 0.6), (0, 0.9), (1, 0.4), (2, 0.6)])]
    steps += [(2, t, 0, 0.5) for t in range(3)]
    df = spark.createDataFrame(steps, "seq int, t int, cls int, prob double")
    kept = runs.collapse_runs(df, ["seq"], ["t"], "cls", 0)
    assert rows(runs.decode_text(kept, ["seq"], ["t"], "cls", 1000), "seq", "text") == [(1, "112")]
    confidence = {r.seq: (r.n_symbols, round(r.confidence, 9)) for r in runs.sequence_confidence(df, kept, ["seq"]).collect()}
    assert confidence == {1: (3, 0.6), 2: (0, 0.0)}


def test_best_class_ties_to_lower(spark, rows):
    df = spark.createDataFrame([(1, 0, 5, 0.5), (1, 0, 2, 0.5), (1, 0, 1, 0.1), (1, 1, 0, 1.0)], "seq int, t int, cls int, prob double")
    assert rows(runs.best_class(df, ["seq", "t"])) == [(1, 0, 2, 0.5), (1, 1, 0, 1.0)]


def box(spark, items):
    data = [
        (page, i, [(x + w, y + h), (x, y), (x + w, y), (x, y + h)], f"t{i}", score)
        for page, i, x, y, w, h, score in items
    ]
    return spark.createDataFrame(data, "page_id long, box_id long, points array<struct<x:double,y:double>>, text string, score double")


def test_reading_order_and_text(spark, rows):
    df = box(spark, [
        (1, 1, 50.0, 3.0, 20.0, 10.0, 0.9), (1, 2, 5.0, 10.0, 20.0, 10.0, 0.5), (1, 3, 5.0, 40.0, 20.0, 10.0, 0.9),
        (1, 4, 30.0, 41.0, 3.0, 10.0, 0.9), (1, 5, 60.0, 40.0, 20.0, 10.0, 0.49), (2, 6, 95.0, 5.0, 20.0, 10.0, 0.9),
        (2, 7, 97.0, 5.0, 20.0, 10.0, 0.9),
    ])
    for bound in (1_000, 1):
        got = rows(boxes.box_text(df, 100, 100, max_group_rows=bound), "page_id", "line_no", "read_pos", "text")
        # 4 is too narrow; 5 scores too low but holds its place; 7 is clipped to two pixels.
        assert got == [(1, 0, 0, "t2"), (1, 0, 1, "t1"), (1, 1, 2, "t3"), (2, 0, 0, "t6")]


@pytest.mark.parametrize("bound", [10_000, 20])
def test_hot_page_reads_the_same(spark, rows, bound):
    rng = random.Random(9)
    items = [(1 if i < 300 else i, i, rng.randrange(50) * 10.0, rng.randrange(60) * 5.0, 9.0, 9.0, 1.0) for i in range(330)]
    got = {r.box_id: (r.line_no, r.read_pos) for r in boxes.reading_order(boxes.clean_boxes(box(spark, items), 1000, 1000), max_group_rows=bound).collect()}
    # Plain loop: corner 0 is the top left.
    want = {}
    for page in {i[0] for i in items}:
        ordered, line, above = sorted((y, x, b) for p, b, x, y, *_ in items if p == page), -1, None
        lined = []
        for y, x, b in ordered:
            line += above is None or y - above >= 10
            above = y
            lined.append((line, x, b))
        want |= {b: (line, pos) for pos, (line, _, b) in enumerate(sorted(lined))}
    assert got == want


def test_min_score_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,), (None,)], "score double")
    assert [r.score for r in boxes.min_score(df).collect()] == [0.5]


@pytest.mark.parametrize("bound", [1_000_000, 5])
def test_insertion_order_equals_the_pairwise_rule(spark, bound):
    random.seed(11)
    items, want = [], {}
    for page in range(12):
        drawn = [(random.choice([0, 1, 5]) * random.random() * 12 + 7 * (i // 3), random.randint(0, 60)) for i in range(random.randint(1, 40))]
        rows = sorted((float(round(y)), float(x), page * 100 + i) for i, (y, x) in enumerate(drawn))
        items += [(page, b, y, x) for y, x, b in rows]
        for i in range(len(rows) - 1):
            for j in range(i, -1, -1):
                if abs(rows[j + 1][0] - rows[j][0]) < 10 and rows[j + 1][1] < rows[j][1]:
                    rows[j], rows[j + 1] = rows[j + 1], rows[j]
                else:
                    break
        want.update({b: at for at, (_, _, b) in enumerate(rows)})
    frame = spark.createDataFrame(items, "page_id long, box_id long, y double, x double").selectExpr(
        "page_id", "box_id", "array(named_struct('x', x, 'y', y)) AS points"
    )
    got = {r.box_id: r.read_pos for r in boxes.insertion_order(frame, max_group_rows=bound).collect()}
    assert got == want


def test_boxes_are_compiled_and_equal_the_rule_by_expressions(spark, rows):
    random.seed(5)
    value = lambda: random.choice([None, -3.0, 0.0, 4.4, 9.0, random.uniform(-20, 90)])
    items = [(i, [(value(), value()) for _ in range(random.choice([4, 4, 4, 3]))]) for i in range(600)]
    frame = spark.createDataFrame(items, "box_id long, points array<struct<x: double, y: double>>")
    got = boxes.clean_boxes(frame, 60, 40)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    by_rule = frame.select("box_id", geometry.clip_points(geometry.order_corners("points"), 60, 40).alias("points"))
    want = by_rule.filter((geometry.side_length("points", 0, 1) > 3) & (geometry.side_length("points", 0, 3) > 3))
    assert rows(got, "box_id", "points") == rows(want, "box_id", "points") and 100 < got.count() < 600


def test_insertion_order_makes_boxes_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    frame = spark.range(40).selectExpr("id % 4 AS page_id", "id AS box_id", "array(named_struct('x', id * 1.0D, 'y', id % 30 * 1.0D)) AS points")
    ordered = boxes.insertion_order(frame.mapInArrow(counted, frame.schema), probe=frame)
    assert made.value == 0
    assert ordered.count() == 40 and made.value == 40
