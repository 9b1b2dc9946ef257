"""Running numbers and maxima of a group's rows without one task for a whole group.

A group is cut at multiples of ``width`` of its order column, a number. Each piece is summed up before the shuffle; sums of earlier
pieces, a row a piece, are added to what runs within a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _pieces(rows: DataFrame, keys: list[str], order: str, width: int, total: Column, before) -> tuple[DataFrame, DataFrame]:
    cut = F.floor(F.col(order) / width)
    sums = rows.groupBy(*keys, cut.alias("__cut")).agg(total.alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__cut").alias("__c"), before("__total").over(earlier).alias("__before"))
    mine = rows.withColumn("__cut", cut)
    same = F.col("__cut").eqNullSafe(F.col("__c"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return mine.join(sums, same, "left").drop("__c", *(f"__{k}" for k in keys)), Window.partitionBy(*keys, "__cut").orderBy(order)


def number(rows: DataFrame, keys: list[str], order: str, out: str, *, width: int = WIDTH) -> DataFrame:
    """Adds the place of each row in its group, from 0."""
    joined, within = _pieces(rows, keys, order, width, F.count("*"), F.sum)
    return joined.withColumn(out, (F.coalesce("__before", F.lit(0)) + F.row_number().over(within) - 1).cast("bigint")).drop("__cut", "__before")


def greatest_before(rows: DataFrame, keys: list[str], order: str, value: str, out: str, *, width: int = WIDTH) -> DataFrame:
    """Adds the greatest value of the group's earlier rows; null for its first and where all are null."""
    joined, within = _pieces(rows, keys, order, width, F.max(value), F.max)
    return joined.withColumn(out, F.greatest("__before", F.max(value).over(within.rowsBetween(Window.unboundedPreceding, -1)))).drop("__cut", "__before")
