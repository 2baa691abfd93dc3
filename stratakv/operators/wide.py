"""Wide-column entities, merges across column families, and secondary indexes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity(**columns: Column) -> Column:
    """A map of column names to text values, in the order of names; null values have no column."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(columns.items())))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def column_of(entity_col: str | Column, name: str) -> Column:
    """A column of an entity; null if it has none."""
    return F.try_element_at(F.col(entity_col) if isinstance(entity_col, str) else entity_col, F.lit(name))


def sorted_columns(entity_col: str | Column) -> Column:
    """The entity's (name, value) entries in the order of names."""
    return F.array_sort(F.map_entries(entity_col))


def coalesced(families: Sequence[DataFrame], key: str = "key", columns: str = "columns") -> DataFrame:
    """One entity per key over several families: of a column in several, the first family's value."""
    ranked = reduce(DataFrame.unionByName, (f.select(key, columns).withColumn("_rank", F.lit(i)) for i, f in enumerate(families)))
    cells = ranked.select(key, "_rank", F.explode(columns).alias("name", "value"))
    first = cells.groupBy(key, "name").agg(F.min_by("value", "_rank").alias("value"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(columns))


def grouped(families: dict[str, DataFrame], key: str = "key", columns: str = "columns") -> DataFrame:
    """One row per key with a map from family to that family's entity."""
    named = reduce(DataFrame.unionByName, (f.select(key, F.lit(n).alias("cf"), columns) for n, f in families.items()))
    return named.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cf", F.map_entries(columns).alias("e"))))).alias("groups"))


def index(view: DataFrame, column: str, key: str = "key") -> DataFrame:
    """A secondary index: (prefix, primary_key); prefix is the value's length and the value, so no
    value's entries lie among those of another. Rows without a value are not in it."""
    v = F.col(column).cast("string")
    return view.where(v.isNotNull()).select(F.concat(F.lpad(F.octet_length(v).cast("string"), 6, "0"), F.lit(":"), v).alias("prefix"), F.col(key).alias("primary_key"))


def lookup(view: DataFrame, indexed: DataFrame, value, key: str = "key") -> DataFrame:
    """Rows of the view whose indexed column has the value, through the index."""
    text = str(value)
    prefix = f"{len(text.encode()):06d}:{text}"
    hits = indexed.where(F.col("prefix") == prefix).select(F.col("primary_key").alias(key))
    return view.join(hits, key, "left_semi")


def attach_static(rows: DataFrame, statics: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Rows with their partition's static columns; partitions with statics only have one row of nulls."""
    return rows.join(statics, list(partition), "full")
