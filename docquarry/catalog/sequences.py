"""Symbol sequences from ``events`` and text boxes from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.base import query, table
from docquarry.operators import boxes as B
from docquarry.operators import runs
from docquarry.session import spread

_RUNS_SQL = """
runs AS (SELECT user_id, ts, event_id, event_type, value FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS DISTINCT FROM event_type AND event_type <> 'error')
"""


def kept(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return events, runs.collapse_runs(events, ["user_id"], ["ts", "event_id"], "event_type", "error")


@query(f"WITH {_RUNS_SQL} SELECT user_id, event_id, event_type, value FROM runs")
def collapse_runs(spark, folder):
    """A user is a sequence, an event type a symbol and ``error`` the blank."""
    return kept(spark, folder)[1].select("user_id", "event_id", "event_type", "value")


@query(f"""
WITH {_RUNS_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM runs)
SELECT user_id, pos // 10 AS piece, count(*) AS n_symbols, string_agg(event_type, ' ' ORDER BY pos) AS text
FROM placed GROUP BY ALL
""")
def decode_text(spark, folder):
    events, starts = kept(spark, folder)
    text = runs.decode_text(starts, ["user_id"], ["ts", "event_id"], "event_type", 10, separator=" ", probe=events)
    return text.withColumn("n_symbols", F.col("n_symbols").cast("long"))


@query(f"""
WITH {_RUNS_SQL}
SELECT user_id, count(runs.event_id) AS n_symbols, round(coalesce(avg(runs.value), 0), 6) AS confidence
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN runs USING (user_id) GROUP BY user_id
""")
def sequence_confidence(spark, folder):
    events, starts = kept(spark, folder)
    return runs.sequence_confidence(events, starts, ["user_id"], "value").withColumn("confidence", F.round("confidence", 6))


_STEPS_SQL = """
steps AS (SELECT user_id, step, cls, prob FROM (
    SELECT user_id, (date_trunc('day', ts) - DATE '2024-01-01'::timestamp) AS gap, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step,
        (props->>'k')::int // 20 AS cls, value AS prob FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id, step ORDER BY prob DESC, cls) = 1)
"""


def best_steps(spark, folder):
    """Per user and day the class (fifth of ``k``) of the highest value."""
    probabilities = table(spark, folder, "events").select(
        "user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("step"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 20).cast("int").alias("cls"), F.col("value").alias("prob"),
    )
    return runs.best_class(probabilities, ["user_id", "step"])


@query(f"WITH {_STEPS_SQL} SELECT user_id, step, cls, prob FROM steps")
def ctc_argmax(spark, folder):
    return best_steps(spark, folder)


@query(f"""
WITH {_STEPS_SQL},
starts AS (SELECT * FROM (SELECT *, lag(cls) OVER (PARTITION BY user_id ORDER BY step) AS before FROM steps)
    WHERE before IS DISTINCT FROM cls AND cls <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS pos FROM starts)
SELECT user_id, pos // 10 AS piece, count(*) AS n_symbols, string_agg(cls::varchar, '' ORDER BY step) AS text
FROM placed GROUP BY ALL
""")
def ctc_decode(spark, folder):
    """Best class per step, runs collapsed, class 0 as blank, symbols joined."""
    events = table(spark, folder, "events")
    starts = runs.collapse_runs(best_steps(spark, folder), ["user_id"], ["step"], "cls", 0, probe=events)
    return runs.decode_text(starts, ["user_id"], ["step"], "cls", 10, probe=events).withColumn("n_symbols", F.col("n_symbols").cast("long"))


WIDTH, HEIGHT = 800, 120

_BOX_SQL = f"""
box AS (SELECT l_orderkey AS page_id, l_partkey * 100000000 + (l_extendedprice * 100)::bigint AS box_id,
    (l_partkey % 500) * 2.0::double AS x, (l_suppkey % 40) * 4.0::double AS y, l_quantity * 2 AS w, 2 + l_tax * 200 AS h,
    l_returnflag || l_linestatus AS text, 1 - l_discount * 8 AS score FROM lineitem),
clipped AS (SELECT page_id, box_id, text, score, trunc(greatest(least(x, {WIDTH - 1}), 0)) AS x1,
    trunc(greatest(least(x + w, {WIDTH - 1}), 0)) AS x2, trunc(greatest(least(y, {HEIGHT - 1}), 0)) AS y1,
    trunc(greatest(least(y + h, {HEIGHT - 1}), 0)) AS y2 FROM box),
clean AS (SELECT * FROM clipped WHERE trunc(x2 - x1) > 3 AND trunc(y2 - y1) > 3),
marked AS (SELECT *, CASE WHEN y1 - lag(y1) OVER (PARTITION BY page_id ORDER BY y1, x1, box_id) < 10 THEN 0 ELSE 1 END AS new FROM clean),
lined AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY y1, x1, box_id ROWS UNBOUNDED PRECEDING) - 1 AS line_no FROM marked),
ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no, x1, box_id) - 1 AS read_pos FROM lined)
"""


def boxes(spark, folder):
    """Line items as boxes: an order is a page; corners are given out of order and may lie outside the page."""
    x, y = (F.col("l_partkey") % 500) * F.lit(2.0), (F.col("l_suppkey") % 40) * F.lit(4.0)
    w, h = F.col("l_quantity") * 2, 2 + F.col("l_tax") * 200
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus")
    return spread(table(spark, folder, "lineitem").select(*columns)).select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("box_id"),
        F.array(corner(x + w, y + h), corner(x, y), corner(x + w, y), corner(x, y + h)).alias("points"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        (1 - F.col("l_discount") * 8).alias("score"),
    )


@query(f"WITH {_BOX_SQL} SELECT page_id, box_id, x1, y1, x2, y2 FROM clean")
def clean_boxes(spark, folder):
    """Corners ordered and clipped, small boxes left out."""
    p = lambda i: F.get("points", F.lit(i))
    return B.clean_boxes(boxes(spark, folder), WIDTH, HEIGHT).select(
        "page_id", "box_id", p(0)["x"].alias("x1"), p(0)["y"].alias("y1"), p(2)["x"].alias("x2"), p(2)["y"].alias("y2")
    )


@query(f"WITH {_BOX_SQL} SELECT page_id, box_id, line_no::bigint AS line_no, read_pos FROM ordered")
def box_reading_order(spark, folder):
    raw = boxes(spark, folder)
    ordered = B.reading_order(B.clean_boxes(raw, WIDTH, HEIGHT), probe=raw)
    return ordered.select("page_id", "box_id", "line_no", "read_pos")


@query(f"""
WITH {_BOX_SQL},
pages_of AS (SELECT page_id, list([{{'y': y1, 'x': x1, 'box': box_id}}] ORDER BY y1, x1, box_id) AS items FROM clean GROUP BY page_id),
done AS (SELECT page_id, list_reduce(items, lambda done, b: done[1:coalesce(list_max(list_transform(done,
        lambda e, i: CASE WHEN abs(b[1].y - e.y) < 10 AND b[1].x < e.x THEN 0 ELSE i END)), 0)] || b
    || done[coalesce(list_max(list_transform(done, lambda e, i: CASE WHEN abs(b[1].y - e.y) < 10 AND b[1].x < e.x THEN 0 ELSE i END)), 0) + 1:]) AS items
    FROM pages_of)
SELECT page_id, items[i].box AS box_id, i - 1 AS read_pos FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM done)
""")
def box_insertion_order(spark, folder):
    """Reading order by insertion of each box into those above it; the SQL does it page by page, uncut."""
    raw = boxes(spark, folder)
    return B.insertion_order(B.clean_boxes(raw, WIDTH, HEIGHT), probe=raw)


@query(f"""
WITH {_BOX_SQL} SELECT page_id, line_no::bigint AS line_no, read_pos, box_id, text, score FROM ordered WHERE score >= 0.5
""")
def box_text(spark, folder):
    """Texts in reading order, low scores left out."""
    return B.box_text(boxes(spark, folder), WIDTH, HEIGHT)
