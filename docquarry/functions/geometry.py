"""Text box geometry: four corner points with ``x`` and ``y``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.common import as_column, let


def corners(points: str | Column) -> list[Column]:
    return [F.get(as_column(points), F.lit(i)) for i in range(4)]


def _keyed(value, take) -> Column:
    return F.array(*[F.struct(value(p).alias("v"), F.lit(i).alias("i")) for i, p in take])


def end_corners(points: str | Column) -> tuple[Column, Column]:
    """Numbers of the corners with the smallest and the largest x+y; ties take the earlier point."""
    four = list(enumerate(corners(points)))
    low = F.array_min(_keyed(lambda p: p["x"] + p["y"], four))["i"]
    high = F.array_min(_keyed(lambda p: -(p["x"] + p["y"]), four))["i"]
    return low, high


def side_corners(points: str | Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Numbers of the corners with the smaller and the larger y-x among those that ``end_corners`` left."""
    four = list(enumerate(corners(points)))

    def between(i: int, value: Column) -> Column:
        # A point taken by its sum gets the largest key, so that it is never picked again.
        taken = (low == i) | (high == i)
        return F.struct(F.when(~taken, value).otherwise(F.lit(float("inf"))).alias("v"), F.lit(i).alias("i"))

    right = F.array_min(F.array(*[between(i, p["y"] - p["x"]) for i, p in four]))["i"]
    left = F.array_min(F.array(*[between(i, p["x"] - p["y"]) for i, p in four]))["i"]
    return right, left


def order_corners(points: str | Column) -> Column:
    """Corners clockwise from the top left: smallest x+y, then smaller y-x, largest x+y, larger y-x.

    Ties take the earlier point, and the two picked by the sum are removed by position.
    """

    def pick(pts: Column) -> Column:
        low, high = end_corners(pts)
        return let(F.struct(low.alias("low"), high.alias("high")), lambda ends: rest(pts, ends["low"], ends["high"]))

    def rest(pts: Column, low: Column, high: Column) -> Column:
        right, left = side_corners(pts, low, high)
        return F.array(*[F.get(pts, i) for i in (low, right, high, left)])

    return let(as_column(points), pick)


def clip_point(point: Column, width: int, height: int) -> Column:
    """A point moved into the page and truncated to whole pixels."""

    def clip(value: Column, size: int) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(float(size - 1))).cast("int").cast("double")

    return F.struct(clip(point["x"], width).alias("x"), clip(point["y"], height).alias("y"))


def clip_points(points: Column, width: int, height: int) -> Column:
    """Points moved into the page and truncated to whole pixels."""
    return let(points, lambda pts: F.array(*[clip_point(p, width, height) for p in corners(pts)]))


def side_length(points: Column, i: int, j: int) -> Column:
    """Whole-pixel distance between corners ``i`` and ``j``."""
    a, b = F.get(points, F.lit(i)), F.get(points, F.lit(j))
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0))).cast("int")
