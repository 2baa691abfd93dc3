"""Spans: range deletes, range keys and the joins between keys and ranges.

Range joins go through a coarse bucket of the key: a range is listed under every bucket it
touches, points under one, and the join is on the bucket with the bounds as a residual. No plan
here is a nested loop over two large tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Bucket = Callable[[Column], Column]


def number_bucket(width: int) -> Bucket:
    """Buckets of a numeric key."""
    return lambda key: F.floor(key / F.lit(width)).cast("long")


def text_bucket(letters: int = 2) -> Bucket:
    """Buckets of a text or binary key by its first bytes, as a number in the order of keys."""
    return lambda key: F.conv(F.rpad(F.substring(F.hex(key), 1, 2 * letters), 2 * letters, "0"), 16, 10).cast("long")


def covered(points: DataFrame, ranges: DataFrame, bucket: Bucket, key: str = "key", how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Points joined to the ranges (start, end, ...) that hold them: start <= key < end.

    ``how`` is inner, left, left_semi or left_anti. ``residual`` may compare ``points.*`` and
    ``ranges.*`` columns further.
    """
    p = points.withColumn("_bucket", bucket(F.col(key))).alias("points")
    r = ranges.where(F.col("start") < F.col("end")).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end"))))
    ).alias("ranges")
    on = (
        (F.col("points._bucket") == F.col("ranges._bucket"))
        & (F.col(f"points.{key}") >= F.col("ranges.start"))
        & (F.col(f"points.{key}") < F.col("ranges.end"))
    )
    if residual is not None:
        on = on & residual
    out = p.join(r, on, how)
    return out.drop("_bucket") if how in ("left_semi", "left_anti") else out.drop(F.col("points._bucket"), F.col("ranges._bucket"))


def masked(points: DataFrame, spans: DataFrame, mask: int, bucket: Bucket) -> DataFrame:
    """Points (key, suffix, ...) that no covering range key hides.

    A range key hides a point if its own suffix is at or above the mask in age (suffix <= mask, as
    a larger suffix is newer) and the point is older than it (point suffix < span suffix).
    Points without a suffix are never hidden.
    """
    active = spans.where(F.col("suffix") <= mask).select("start", "end", F.col("suffix").alias("span_suffix"))
    return covered(points, active, bucket, how="left_anti", residual=F.col("points.suffix") < F.col("ranges.span_suffix"))


def truncate(spans: DataFrame, lo, hi) -> DataFrame:
    """Spans cut to [lo, hi); those outside go."""
    cut = spans.withColumns({"start": F.greatest("start", F.lit(lo)), "end": F.least("end", F.lit(hi))})
    return cut.where(F.col("start") < F.col("end"))


def excise(spans: DataFrame, lo, hi) -> DataFrame:
    """Spans without the part in [lo, hi): what is left on both sides."""
    left = spans.withColumn("end", F.least("end", F.lit(lo)))
    right = spans.withColumn("start", F.greatest("start", F.lit(hi)))
    return left.unionByName(right).where(F.col("start") < F.col("end"))


def fragments(spans: DataFrame) -> DataFrame:
    """Disjoint pieces (start, end) between neighbouring bounds, each with the spans that cover it.

    Only neighbouring bounds are paired, per group of spans that overlap without a gap.
    """
    grouped = islands(spans, keep=True)
    bounds = grouped.select("island", F.col("start").alias("at")).union(grouped.select("island", "end")).distinct()
    pieces = bounds.withColumn("to", F.lead("at").over(Window.partitionBy("island").orderBy("at"))).where("to is not null")
    return pieces.join(grouped, "island").where((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("to"))).drop("start", "end").withColumnsRenamed({"at": "start", "to": "end"})


def newest_per_piece(spans: DataFrame) -> DataFrame:
    """(start, end, suffix, value): for each piece and suffix the value of the newest span; deleted ones go.

    A span of kind UNSET removes its suffix, one of kind DEL all suffixes, of older spans.
    """
    pieces = fragments(spans)
    window = Window.partitionBy("start", "end")
    pieces = pieces.withColumn("_del", F.coalesce(F.max(F.when(F.col("kind") == "DEL", F.col("seq"))).over(window), F.lit(-1)))
    top = pieces.where((F.col("kind") != "DEL") & (F.col("seq") > F.col("_del"))).groupBy("start", "end", "suffix").agg(
        F.max_by(F.struct("kind", "value"), "seq").alias("top")
    )
    return top.where(F.col("top.kind") == "SET").select("start", "end", "suffix", F.col("top.value").alias("value"))


def islands(spans: DataFrame, by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Unions of overlapping or touching spans per group: (by, start, end), or the spans with ``island``."""
    by = by or []
    if not by:  # one group may be the whole table: through key ranges, no single task
        from . import ranks

        marked = ranks.reach(spans, ["start", "end"], "end", "_reach")
        starts = (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("int")
        numbered = ranks.running(marked.withColumn("_new", starts), ["start", "end"], {"_before": F.col("_new")})
        # equal spans share an island: only the first of them may start it
        numbered = numbered.withColumn("island", F.col("_before") + F.col("_new")).drop("_reach", "_new", "_before")
        if keep:
            return numbered
        return numbered.groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    if keep:
        return numbered
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def coverage(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Per group: number of keys in the union of inclusive integer ranges (lo, hi), and of the ranges."""
    # of ranges with one start the longest holds the others, so the order of starts has no ties
    spans = ranges.groupBy(*by, F.col("lo").alias("start")).agg((F.max("hi") + 1).alias("end"))
    united = islands(spans, by)
    return united.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"), F.count(F.lit(1)).alias("islands"))
