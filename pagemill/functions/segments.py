"""Ordered windows over groups of any size, in two levels: within ranges of the order, then over one row for each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Segments:
    """Groups by ``key`` in the order of ``order``, whose first column is an integer that spreads over the group's rows.

    A range holds the rows of ``width`` values of that column, so a group with a third of all rows becomes as many
    tasks as it has ranges; only its ranges, one small row each, meet in one window. Key columns aren't null.
    """

    def __init__(self, key: list[str], order: list[str], width: int = 1024):
        self.key, self.order, self.width = key, order, width
        self.cell = [*key, "_range"]

    def split(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_range", F.floor(F.col(self.order[0]) / self.width))

    def _inside(self, first: int, last: int):
        return Window.partitionBy(*self.cell).orderBy(*self.order).rowsBetween(first, last)

    def _between(self, ranges: DataFrame, carried: Column) -> DataFrame:
        return ranges.select(*self.cell, carried.alias("_carry"))

    def running_sum(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """df + name: the sum of value over the rows up to each one; null counts as 0."""
        rows = self.split(df).withColumn("_v", F.coalesce(value, F.lit(0)))
        totals = rows.groupBy(*self.cell).agg(F.sum("_v").alias("_t"))
        before = F.coalesce(F.sum("_t").over(Window.partitionBy(*self.key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = rows.withColumn(name, F.sum("_v").over(self._inside(Window.unboundedPreceding, 0)))
        return inside.join(self._between(totals, before), self.cell).withColumn(name, F.col(name) + F.col("_carry")).drop("_range", "_carry", "_v")

    def row_number(self, df: DataFrame, name: str) -> DataFrame:
        """df + name: the place of each row in its group, from 1."""
        return self.running_sum(df, F.lit(1), name)

    def lead(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """df + name: value of the next row of the group; null for the last."""
        rows = self.split(df).withColumn("_v", F.struct(value.alias("v")))
        firsts = rows.groupBy(*self.cell).agg(F.min_by("_v", F.struct(*self.order)).alias("_f"))
        after = F.lead("_f").over(Window.partitionBy(*self.key).orderBy("_range"))
        inside = rows.withColumn("_n", F.lead("_v").over(Window.partitionBy(*self.cell).orderBy(*self.order)))
        return inside.join(self._between(firsts, after), self.cell).withColumn(name, F.coalesce("_n", "_carry")["v"]).drop("_range", "_carry", "_v", "_n")

    def lag(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """df + name: value of the row before; null for the first."""
        rows = self.split(df).withColumn("_v", F.struct(value.alias("v")))
        lasts = rows.groupBy(*self.cell).agg(F.max_by("_v", F.struct(*self.order)).alias("_f"))
        before = F.lag("_f").over(Window.partitionBy(*self.key).orderBy("_range"))
        inside = rows.withColumn("_n", F.lag("_v").over(Window.partitionBy(*self.cell).orderBy(*self.order)))
        return inside.join(self._between(lasts, before), self.cell).withColumn(name, F.coalesce("_n", "_carry")["v"]).drop("_range", "_carry", "_v", "_n")

    def last_value(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """df + name: the last value that isn't null, of the rows up to each one."""
        rows = self.split(df).withColumn("_v", value)
        lasts = rows.groupBy(*self.cell).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*self.order))).alias("_f"))
        before = F.last("_f", ignorenulls=True).over(Window.partitionBy(*self.key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        inside = rows.withColumn(name, F.last("_v", ignorenulls=True).over(self._inside(Window.unboundedPreceding, 0)))
        return inside.join(self._between(lasts, before), self.cell).withColumn(name, F.coalesce(name, "_carry")).drop("_range", "_carry", "_v")
