"""Text boxes of a page: clean-up and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.common import let
from docquarry.functions.geometry import clip_point, end_corners, side_corners, side_length
from docquarry.operators.segments import MAX_GROUP_ROWS, Ordered, largest_group
from docquarry.params import DROP_SCORE

# Sides of at most this many pixels are noise; line tolerance in pixels.
MIN_SIDE = 3
LINE_TOLERANCE = 10


def min_score(df: DataFrame, threshold: float = DROP_SCORE, score: str = "score") -> DataFrame:
    """Rows with a score at or above the threshold."""
    return df.filter(F.col(score) >= F.lit(threshold))


def clean_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Corners in order, moved into the page; boxes with a side of at most three pixels are left out."""
    # Step by step in columns of their own, which are compiled; inside a lambda the same would be interpreted.
    low, high = end_corners("points")
    ends = boxes.select("*", low.alias("__low"), high.alias("__high"))
    right, left = side_corners("points", F.col("__low"), F.col("__high"))
    sides = ends.select("*", right.alias("__right"), left.alias("__left"))
    keep = [c for c in boxes.columns if c != "points"]
    clipped = [clip_point(F.get("points", F.col(i)), width, height) for i in ("__low", "__right", "__high", "__left")]
    placed = sides.select(*keep, F.array(*clipped).alias("__points"))
    p = F.col("__points")
    large = (side_length(p, 0, 1) > MIN_SIDE) & (side_length(p, 0, 3) > MIN_SIDE)
    # Exploding none or one box computes the corners once; a filter would compute them again per use.
    return placed.select(*keep, F.explode(F.when(large, F.array(p))).alias("points"))


def _lines(boxes: DataFrame, page: str, box: str, tolerance: float, max_group_rows: int, largest: int) -> DataFrame:
    """Adds ``line_no``: a box that is ``tolerance`` or more below the one before opens a line; and ``__x``, ``__y``."""
    corner = F.get("points", F.lit(0))
    placed = boxes.withColumn("__x", corner["x"]).withColumn("__y", corner["y"])
    down = Ordered.of(placed, [page], ["__y", "__x", box], max_group_rows, largest=largest).previous("__y", "__above")
    breaks = F.col("__above").isNull() | (F.col("__y") - F.col("__above") >= tolerance)
    opened = Ordered(down.df.withColumn("__new", breaks.cast("long")), down.by, down.order, down.split)
    lines = opened.running_sum("__new", "line_no").result()
    return lines.withColumn("line_no", F.col("line_no") - 1).drop("__above", "__new")


def reading_order(
    boxes: DataFrame, page: str = "page_id", box: str = "box_id", tolerance: float = LINE_TOLERANCE,
    max_group_rows: int = MAX_GROUP_ROWS, probe: DataFrame | None = None,
) -> DataFrame:
    """Adds ``line_no`` and ``read_pos`` (from 0): lines from top to bottom, boxes of a line from left to right.

    Going down the page a box closer than ``tolerance`` to the one before stays on its line.
    """
    largest = largest_group(boxes if probe is None else probe, [page])
    lines = _lines(boxes, page, box, tolerance, max_group_rows, largest)
    across = Ordered.of(lines, [page], ["line_no", "__x", box], max_group_rows, largest=largest)
    return across.position("read_pos").result().drop("__x", "__y")


def insertion_order(
    boxes: DataFrame, page: str = "page_id", box: str = "box_id", tolerance: float = LINE_TOLERANCE,
    max_group_rows: int = MAX_GROUP_ROWS, probe: DataFrame | None = None,
) -> DataFrame:
    """``(page, box, read_pos)`` by insertion: from top to bottom, each box moves left past boxes that are less than
    ``tolerance`` away in height and begin further right, until one is not.

    Differs from ``reading_order`` where heights drift along a line. A box never moves past a gap of ``tolerance`` in
    height, so a page is cut there and its stretches are ordered apart; only a box's number, place and height are gathered.
    """
    largest = largest_group(boxes if probe is None else probe, [page])
    lines = _lines(boxes, page, box, tolerance, max_group_rows, largest)
    item = F.struct(F.col("__y").alias("y"), F.col("__x").alias("x"), F.col(box).alias("box"))
    stretches = lines.groupBy(page, "line_no").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def insert(done, new):
        stays = F.transform(
            done, lambda e, i: F.when((F.abs(new["y"] - e["y"]) < tolerance) & (new["x"] < e["x"]), F.lit(0)).otherwise(i + 1)
        )
        return let(
            F.coalesce(F.array_max(stays), F.lit(0)),
            lambda at: F.concat(F.slice(done, F.lit(1), at), F.array(new), F.slice(done, at + 1, F.size(done) - at)),
        )

    empty = F.filter("items", lambda _: F.lit(False))
    inserted = F.when(F.size("items") == 1, F.col("items")).otherwise(F.aggregate("items", empty, insert))
    placed = stretches.select(page, "line_no", inserted.alias("items"), F.size("items").cast("long").alias("n"))
    # A page has no more stretches than boxes: counting the stretches would order all boxes twice.
    through = Ordered.of(placed, [page], ["line_no"], max_group_rows, largest=largest).running_sum("n", "through").result()
    return through.select(page, (F.col("through") - F.col("n")).alias("before"), F.posexplode("items").alias("at", "item")).select(
        page, F.col("item.box").alias(box), (F.col("before") + F.col("at")).alias("read_pos")
    )


def box_text(
    boxes: DataFrame, width: int, height: int, threshold: float = DROP_SCORE, page: str = "page_id",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Texts of a page in reading order, one row per text.

    Order is fixed over all clean boxes first and low scores are dropped after, so a dropped box
    still takes part in forming lines.
    """
    ordered = reading_order(clean_boxes(boxes, width, height), page, max_group_rows=max_group_rows, probe=boxes)
    return min_score(ordered, threshold).select(page, "line_no", "read_pos", "box_id", "text", "score")
