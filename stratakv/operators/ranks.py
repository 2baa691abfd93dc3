"""Ranks and running sums over a whole table in order, without a task that holds all rows.

Rows are dealt to key ranges and written, each range is summed within its own task, and the sums of
the ranges before it (one row for each range) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import export


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """The rows with the exclusive running sum of each column of ``sums``, in the order of columns.

    With ``by`` sums start anew in each group. Rows that are equal in all of ``by`` and ``order``
    are summed in any order.
    """
    keys = [*by, *order]
    summed = df.select("*", *(c.cast("long").alias(f"_x_{n}") for n, c in sums.items()))
    dealt = summed.repartitionByRange(*(F.col(k) for k in keys)).withColumn("_range", F.spark_partition_id())
    written = export(dealt, "ranges")
    before = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = written.groupBy("_range").agg(*(F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums))
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(ranges), F.lit(0)).alias(f"_o_{n}") for n in sums))
    placed = written.join(F.broadcast(offsets), "_range")
    out = placed.select(*df.columns, *((F.coalesce(F.sum(f"_x_{n}").over(before), F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums))
    if not by:
        return out
    first = out.groupBy(*by).agg(*(F.min(n).alias(f"_f_{n}") for n in sums))
    joined = out.join(first, list(by))
    return joined.select(*df.columns, *((F.col(n) - F.col(f"_f_{n}")).alias(n) for n in sums))


def reach(df: DataFrame, order: Sequence[str], column: str, name: str) -> DataFrame:
    """The rows with the largest value of ``column`` before each row in the order of columns; null for the first."""
    written = export(df.repartitionByRange(*(F.col(k) for k in order)).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    tops = written.groupBy("_range").agg(F.max(column).alias("_top")).select("_range", F.max("_top").over(ranges).alias("_carried"))
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = written.join(F.broadcast(tops), "_range")
    return placed.select(*df.columns, F.greatest(F.max(column).over(before), F.col("_carried")).alias(name))


def following(points: DataFrame, keys: DataFrame, at: str, key: str, name: str) -> DataFrame:
    """The points with the least key at or after each point's ``at``; null beyond the last key and for a null ``at``."""
    rows = points.withColumn("_at", F.col(at)).unionByName(keys.select(F.col(key).alias("_at"), F.col(key).alias("_key")), allowMissingColumns=True)
    written = export(rows.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    heads = written.groupBy("_range").agg(F.min("_key").alias("_head")).select("_range", F.min("_head").over(ranges).alias("_beyond"))
    # from the last key down, so the frame only grows and each row is looked at once
    within = F.min("_key").over(Window.partitionBy("_range").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.when(F.col("_at").isNotNull(), F.coalesce(within, F.col("_beyond")))
    placed = written.join(F.broadcast(heads), "_range").withColumn(name, found)
    return placed.where("_key is null").select(*points.columns, name)


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """The rows with their position from 0 in the order of columns (of each group)."""
    return running(df, order, {name: F.lit(1)}, by)
