"""Operator 9, sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and its own name; the record goes to the shard
with the least ``-ln(u) / weight``. A shard gets rows in proportion to its weight, and adding one
moves only the rows that the new shard wins. Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Hex digits of the digest that make the uniform number: 52 bits, exact in a double.
DIGITS = 13


def record_key(col: Column) -> Column:
    """The stable key as text; null keys share one key that no other value has."""
    return F.coalesce(col.cast("string"), F.lit("\u0000null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins the key; of equal draws the lower shard wins."""

    def draw(i: int, weight: float) -> Column:
        if weight <= 0:
            raise ValueError("weights must be positive")
        word = F.substring(F.md5(F.concat(key, F.lit(f":{i}")).cast("binary")), 1, DIGITS)
        u = (F.conv(word, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(i).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return F.least(*(draw(i, w) for i, w in enumerate(weights)))["shard"]


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Shard, size, checksum and place of every row.

    Returns (id_col, size, text_crc32, shard, slot, grown_shard): size is the UTF-8 bytes of the
    text plus 1 (null: 1), the checksum is unsigned; slot counts the rows of a shard without gaps
    from 0 in the order of the key; grown_shard is the shard under the weights ``grown``.

    Slots come from ranges of the key (sampled bounds): rows are counted by (range, shard), the
    counts are summed over the ranges before, and rows are numbered within a (range, shard) only,
    so no task sees a whole shard. Repeated rows get slots of their own; null keys come first;
    rows with one key may lie in several ranges, as the bounds also look at checksum, size and a
    row number. The range of a row is written down, so a recomputed task can't change it.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    key = record_key(F.col(id_col))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        (rendezvous(key, grown) if grown else F.lit(None).cast("int")).alias("grown"),
        F.monotonically_increasing_id().alias("uid"),
    )
    order = ["id", "crc", "size", "uid"]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        materialize(narrow, "shard-rows")
        .repartitionByRange(partitions, *order)
        .withColumn("range", F.spark_partition_id()),
        "shard-ranges",
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        ranged.groupBy("range", "shard")
        .count()
        .select("range", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )  # at most partitions x shards rows
    within = Window.partitionBy("range", "shard").orderBy(*order)
    return (
        ranged.withColumn("at", F.row_number().over(within))
        .join(F.broadcast(firsts), ["range", "shard"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
            F.col("grown").alias("grown_shard"),
        )
    )
