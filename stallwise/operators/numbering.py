"""Global places of rows in an order, without one task that sees them all.

Rows are dealt by ranges of the order and sorted within; a range's rows are counted (or weighed) from its beginning, and
the ranges before it are summed up. Only one number for each range reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.operators.lineage import written


def numbered(df: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """df with each row's place from 0 in the order of the columns, nulls first; rows equal in all of them in any order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    return before_ranges(placed, F.count(F.lit(1))).withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def cumulated(df: DataFrame, order: str, weight: str, name: str = "before") -> DataFrame:
    """df, whose values of the order column are distinct, with the weight of all rows that come before."""
    dealt = written(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    within = F.sum(weight).over(Window.partitionBy("_p").orderBy(order)) - F.col(weight)
    return before_ranges(dealt.withColumn("_w", within), F.sum(weight)).withColumn(name, F.col("_before") + F.col("_w")).drop("_p", "_w", "_before")


def before_ranges(placed: DataFrame, total) -> DataFrame:
    """placed with _before: the total of the ranges (_p) before a row's own."""
    totals = sorted((r["_p"], r["t"]) for r in placed.groupBy("_p").agg(total.alias("t")).collect())
    rows, so_far = [], 0
    for p, t in totals:
        rows.append((p, so_far))
        so_far += t
    return placed.join(F.broadcast(placed.sparkSession.createDataFrame(rows, "_p int, _before long")), "_p")


def ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with the mean rank, from 1, of each value among the values that are not null; null for null."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = cumulated(counts, "_v", "_c").select("_v", (F.col("before") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(placed, F.col(value) == F.col("_v"), "left").drop("_v")
