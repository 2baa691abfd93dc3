"""Aggregates with the query language's result types, grouping by key prefixes, user aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def typed_sum(df: DataFrame, column: str) -> Column:
    """SUM has the type of its input."""
    return F.sum(column).cast(df.schema[column].dataType)


def typed_avg(df: DataFrame, column: str) -> Column:
    """AVG has the type of its input: whole numbers are cut toward zero."""
    kind = df.schema[column].dataType
    mean = F.avg(column)
    if isinstance(kind, _WHOLE):
        mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean))
    return mean.cast(kind)


def group_by_prefix(df: DataFrame, prefix: Sequence[str], rest_of_key: Sequence[str], first: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """Groups of a primary-key prefix; columns ``first`` take the group's first row in key order."""
    heads = [F.min_by(c, F.struct(*rest_of_key)).alias(c) for c in first]
    return df.groupBy(*prefix).agg(*heads, *(a.alias(n) for n, a in aggregates.items()))


def per_partition_limit(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most n rows per partition, in clustering order (a group limit prunes before the shuffle)."""
    at = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def user_aggregate(value: Column, order: Column, initial: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> Column:
    """A user-defined aggregate: state function over the group's values in order, then a final one."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda p: p["v"])
    return F.aggregate(values, initial, step, final) if final else F.aggregate(values, initial, step)


def exact_distinct(column: str) -> Column:
    return F.count_distinct(column)


def sketch_distinct(df: DataFrame, column: str, by: Sequence[str] = (), log_size: int = 12) -> DataFrame:
    """Distinct count by a theta (bottom-k) sketch; exact below the sketch's size."""
    sketch = F.expr(f"theta_sketch_agg(`{column}`, {log_size})")
    return df.groupBy(*by).agg(sketch.alias("sketch")).select(*by, F.expr("theta_sketch_estimate(sketch)").cast("long").alias("n"))


def sketch_union(df: DataFrame, column: str, by: Sequence[str], log_size: int = 12) -> DataFrame:
    """Distinct count over all groups from the union of their sketches."""
    parts = df.groupBy(*by).agg(F.expr(f"theta_sketch_agg(`{column}`, {log_size})").alias("sketch"))
    return parts.agg(F.expr("theta_sketch_estimate(theta_union_agg(sketch))").cast("long").alias("n"))
