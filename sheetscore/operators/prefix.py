"""Running totals in a global order that do not need one task per key.

Small keys use a plain window. If a key is too large for one task, the rows are
range-partitioned in the wanted order, the slice number is fixed by a
checkpoint (a lost executor cannot change it), each slice is windowed alone,
and slice totals - one row per key and slice - supply the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .groups import oversized, small_table

MAX_WINDOW_ROWS = 2_000_000


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[Column]
    sliced: bool

    def _window(self, *order: Column):
        keys = [*self.keys, "_slice"] if self.sliced else self.keys
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def _offsets(self, totals: dict[str, Column], slices: Column, fold) -> DataFrame:
        """Per (key, slice): `fold` over the slices that come before it in the order `slices`; one row each, brought over once."""
        w = Window.partitionBy(*self.keys).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
        rows = self.df.groupBy(*self.keys, "_slice").agg(*[c.alias(out) for out, c in totals.items()])
        return small_table(rows.select(*self.keys, "_slice", *[fold(out).over(w).alias(out) for out in totals]))

    def running(self, **sums: Column) -> "Ordered":
        """Add inclusive running sums."""
        df = self.df
        for out, c in sums.items():
            df = df.withColumn(out, F.sum(c).over(self._window(*self.order)))
        if self.sliced:
            before = self._offsets({f"_{out}": F.sum(c) for out, c in sums.items()}, F.asc("_slice"), F.sum)
            df = df.join(before, [*self.keys, "_slice"])
            df = df.withColumns({out: F.col(out) + F.coalesce(f"_{out}", F.lit(0)) for out in sums}).drop(*[f"_{out}" for out in sums])
        return replace(self, df=df)

    def max_from_here(self, out: str, c: Column, number: str) -> "Ordered":
        """Add the maximum over this row and all later ones.

        `number` counts the rows in order. The window runs backwards: a frame
        that ends at the last row would be read again for every row.
        """
        df = self.df.withColumn(out, F.max(c).over(self._window(F.desc(number))))
        if self.sliced:
            after = self._offsets({"_after": F.max(c)}, F.desc("_slice"), F.max)
            df = df.join(after, [*self.keys, "_slice"]).withColumn(out, F.greatest(out, "_after")).drop("_after")
        return replace(self, df=df)

    def done(self) -> DataFrame:
        return self.df.drop("_slice")


def ordered(
    df: DataFrame, keys: list[str], order: list[Column], max_rows: int = MAX_WINDOW_ROWS, counted: DataFrame | None = None
) -> Ordered:
    """`order` must be total within a key.

    `counted` is a cheaper table that has at least as many rows per key.
    """
    df = cut(df) if counted is None else df
    if oversized(df if counted is None else counted, keys, max_rows) is None:
        return Ordered(df, keys, order, False)
    by = [*[F.col(k) for k in keys], *order]
    # the bounds of the ranges are sampled first, so the rows are read twice: derive them once
    df = df if counted is None else cut(df)
    sliced = cut(df.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id()))
    return Ordered(sliced, keys, order, True)


def sequential_ids(df: DataFrame, order: list[Column], out: str, start: int = 0, max_rows: int = MAX_WINDOW_ROWS) -> DataFrame:
    """Number all rows in a global order."""
    one = F.lit(1).cast("long")
    return ordered(df, [], order, max_rows).running(**{out: one}).done().withColumn(out, F.col(out) - 1 + start)
