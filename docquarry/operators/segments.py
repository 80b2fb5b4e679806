"""Ordered computations inside groups of any size.

A plain window puts a whole group into one task. ``Ordered`` first counts the largest group. If
that is within the bound, plain windows are used. If not, rows are range-partitioned by group and
order, so that a hot group is cut into consecutive segments on several tasks; windows run per
segment, and what one segment must know of the earlier ones is carried over in a small table.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import broadcast_if_small, materialise

MAX_GROUP_ROWS = 1_000_000
_SEGMENT = "__segment"


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    @staticmethod
    def of(
        df: DataFrame, by: list[str], order: list[str], max_group_rows: int = MAX_GROUP_ROWS,
        probe: DataFrame | None = None, largest: int | None = None,
    ) -> Ordered:
        """``order`` must be unique inside a group (end it with an id).

        ``probe`` is a cheaper frame with at least as many rows in every group, to count instead of ``df``;
        ``largest`` a bound of the rows of a group that is known already.
        """
        if largest is None:
            largest = largest_group(df if probe is None else probe, by)
        if largest <= max_group_rows:
            return Ordered(df, tuple(by), tuple(order), False)
        # The bounds of a range partitioning are sampled anew in every job: store the result,
        # so that all later steps see the same segments.
        cut = df.repartitionByRange(*by, *order).withColumn(_SEGMENT, F.spark_partition_id())
        return Ordered(materialise(cut, "segments"), tuple(by), tuple(order), True)

    @property
    def _group(self) -> list[str]:
        return [*self.by, _SEGMENT] if self.split else list(self.by)

    def _window(self):
        return Window.partitionBy(*self._group).orderBy(*self.order)

    def _carry(self, edge, combine) -> DataFrame:
        """Per segment, what the earlier segments of the same group hand over.

        Only groups that span segments are kept: at most two rows per partition, whatever the data.
        """
        edges = self.df.groupBy(*self._group).agg(edge.alias("__edge"))
        group = Window.partitionBy(*self.by)
        carried = (
            edges.withColumn("__spans", F.count("*").over(group))
            .filter("__spans > 1")
            .withColumn("__carry", combine(group.orderBy(_SEGMENT)))
            .select(*self._group, "__carry")
        )
        return broadcast_if_small(carried)

    def _join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in self._group]
        return df.alias("l").join(carry.alias("c"), on, "left").select("l.*", "c.__carry")

    def previous(self, value: str, output: str) -> Ordered:
        """Adds the value of the row before in the group's order; null on the first row."""
        lagged = F.lag(value).over(self._window())
        if not self.split:
            return replace(self, df=self.df.withColumn(output, lagged))
        carry = self._carry(
            F.max_by(F.struct(value), F.struct(*self.order)),
            lambda window: F.lag("__edge").over(window)[value],
        )
        numbered = self.df.withColumn("__n", F.row_number().over(self._window())).withColumn(output, lagged)
        joined = self._join_carry(numbered, carry)
        filled = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col(output))
        return replace(self, df=joined.withColumn(output, filled).drop("__n", "__carry"))

    def running_sum(self, value: str, output: str) -> Ordered:
        """Adds the sum of ``value`` up to and with the row."""
        summed = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if not self.split:
            return replace(self, df=self.df.withColumn(output, summed))
        carry = self._carry(
            F.sum(value),
            lambda window: F.sum("__edge").over(window.rowsBetween(Window.unboundedPreceding, -1)),
        )
        joined = self._join_carry(self.df.withColumn(output, summed), carry)
        total = F.col(output) + F.coalesce(F.col("__carry"), F.lit(0))
        return replace(self, df=joined.withColumn(output, total).drop("__carry"))

    def position(self, output: str) -> Ordered:
        """Adds the row's place in its group, from 0."""
        one = replace(self, df=self.df.withColumn("__one", F.lit(1).cast("long")))
        counted = one.running_sum("__one", output)
        return replace(counted, df=counted.df.withColumn(output, F.col(output) - 1).drop("__one"))

    def result(self) -> DataFrame:
        return self.df.drop(_SEGMENT)
