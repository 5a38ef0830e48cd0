"""Running values over keys of any size. A window sorts all rows of a key in one task, which is right for keys that fit one;
keys with more than HOT_ROWS rows are cut into ranges of their order instead, each scanned by itself, and what the ranges
before leave (a minimum, a sum, a count, the last rows) is carried on by a join of range totals.

Rows of hot keys are dealt out once by range and written to the shared folder, so ranges stay as they are when an executor is
lost. There is at most one hot key for HOT_ROWS rows, and a few ranges for each, so the lists of both are small and are
broadcast. Order columns should tell a key's rows apart; rows that they don't tell apart stand in any order, in one range.
Null keys are keys like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tracemill.shared import stored

HOT_ROWS = 4_000_000
PART = "_part"


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    """The columns `by` are equal, nulls too, with these prefixes."""
    return reduce(lambda x, y: x & y, [F.col(left + c).eqNullSafe(F.col(right + c)) for c in by])


class Segments:
    """rows, dealt into segments: `rows` has the segment's number within its key in the column PART (0 where a key is not
    cut). `cut` tells whether any key is."""

    def __init__(self, rows: DataFrame, by: Sequence[str], order: Sequence[str], sizes: DataFrame | None = None):
        """sizes: a frame whose rows of a key are no fewer than those of rows, where counting it is cheaper."""
        self.by, self.order = list(by), list(order)
        sizes = (rows if sizes is None else sizes).groupBy(*self.by).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
        hot = sizes.collect()  # at most one for HOT_ROWS rows
        self.cut = bool(hot)
        self.rows = rows.withColumn(PART, F.lit(0))
        if self.cut:
            keys = F.broadcast(rows.sparkSession.createDataFrame(hot, sizes.schema)).alias("_keys")
            ranges = sum(-(-r["_n"] // HOT_ROWS) + 1 for r in hot) * 2
            inside = rows.alias("_rows").join(keys, _same("_rows.", "_keys.", self.by), "left_semi") if self.by else rows
            dealt = stored(inside.repartitionByRange(ranges, *self.by, *self.order).withColumn(PART, F.spark_partition_id() + 1))
            if self.by:
                outside = rows.alias("_rows").join(keys, _same("_rows.", "_keys.", self.by), "left_anti")
                dealt = dealt.unionByName(outside.withColumn(PART, F.lit(0)))
            self.rows = dealt

    def window(self) -> WindowSpec:
        """Over a segment, in order."""
        return Window.partitionBy(*self.by, PART).orderBy(*self.order)

    def carry(self, rows: DataFrame, **totals: tuple[Column, str]) -> DataFrame:
        """rows (self.rows with more columns) with a column for each total: the aggregate of it over the segments before,
        null in the first. totals: name = (aggregate over a segment, "sum", "min" or "max" of segments)."""
        if not self.cut:
            kinds = rows.agg(*[a.alias(n) for n, (a, _) in totals.items()]).schema
            return rows.withColumns({n: F.lit(None).cast(kinds[n].dataType) for n in totals})
        before = Window.partitionBy(*self.by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.where(F.col(PART) > 0).groupBy(*self.by, PART).agg(*[a.alias(n) for n, (a, _) in totals.items()])
        parts = parts.select(*self.by, PART, *[getattr(F, how)(n).over(before).alias(n) for n, (_, how) in totals.items()])
        keyed = F.broadcast(parts.select(*[F.col(c).alias(f"_k_{c}") for c in [*self.by, PART]], *totals))
        joined = rows.join(keyed, _same("", "_k_", [*self.by, PART]), "left")
        return joined.drop(*[f"_k_{c}" for c in [*self.by, PART]])

    def numbered(self, name: str) -> DataFrame:
        """self.rows with the row's number within its key, from 1."""
        rows = self.carry(self.rows.withColumn(name, F.row_number().over(self.window())), _before=(F.count(F.lit(1)), "sum"))
        return rows.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_before")

    def summed(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the sum of value up to and with each; null until the first value that is not."""
        within = F.sum("_v").over(self.window().rowsBetween(Window.unboundedPreceding, 0))
        rows = self.carry(rows.withColumn("_v", value).withColumn(name, within), _before=(F.sum("_v"), "sum"))
        total = F.when(F.col(name).isNull(), F.col("_before")).otherwise(F.col(name) + F.coalesce(F.col("_before"), F.lit(0)))
        return rows.withColumn(name, total).drop("_v", "_before")
