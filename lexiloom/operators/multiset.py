"""Multiset differences of arrays: what the left has more often than the right, first occurrences first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_minus(left: Column, right: Column) -> Column:
    """Array form for short lists in one row: for each value, its first (count left - count right) occurrences, in order."""

    def count(xs: Column, v: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == v))

    return F.filter(left, lambda x, i: count(F.slice(left, F.lit(1), i + 1), x) <= count(left, x) - count(right, x))


def multiset_except(left: DataFrame, right: DataFrame, group: list[str], key: str, order: str) -> DataFrame:
    """Exploded form for long lists: rows of left whose occurrence number exceeds what right holds of the key, per group. One shuffle a side by (group, key)."""
    n = F.row_number().over(Window.partitionBy(*group, key).orderBy(order))
    total = F.count("*").over(Window.partitionBy(*group, key))
    held = right.groupBy(*group, key).agg(F.count("*").alias("_held"))
    counted = left.withColumn("_n", n).withColumn("_total", total)
    return counted.join(held, [*group, key], "left").where(F.col("_n") <= F.col("_total") - F.coalesce("_held", F.lit(0))).drop("_n", "_total", "_held")
