"""Ordered key-value reads on a live view (key, value, ...): gets, seeks, scans, pages, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(view: DataFrame, key, column: str = "key") -> DataFrame:
    """The row of a key; empty if there is none."""
    return view.where(F.col(column) == F.lit(key))


def multi_get(view: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """One row for each row of ``keys`` (column of the same name) with ``found``; nulls where not."""
    hit = view.withColumn("_hit", F.lit(True))
    return keys.join(hit, column, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def scan(view: DataFrame, reverse: bool = False, columns: Sequence[str] = ("key",)) -> DataFrame:
    return view.orderBy(*(F.desc(c) if reverse else F.asc(c) for c in columns))


def seek(view: DataFrame, target, column: str = "key") -> DataFrame:
    """The first row at or after a key."""
    return view.where(F.col(column) >= F.lit(target)).orderBy(column).limit(1)


def seek_for_prev(view: DataFrame, target, column: str = "key") -> DataFrame:
    """The last row at or before a key."""
    return view.where(F.col(column) <= F.lit(target)).orderBy(F.desc(column)).limit(1)


def between(view: DataFrame, lo=None, hi=None, column: str = "key") -> DataFrame:
    """Rows in [lo, hi); None is open."""
    if lo is not None:
        view = view.where(F.col(column) >= F.lit(lo))
    return view if hi is None else view.where(F.col(column) < F.lit(hi))


def step_with_limit(view: DataFrame, position, limit, reverse: bool = False, column: str = "key") -> DataFrame:
    """The next row beyond a position that does not pass the limit key; empty if it would."""
    c = F.col(column)
    if reverse:
        return view.where((c < F.lit(position)) & (c >= F.lit(limit))).orderBy(F.desc(column)).limit(1)
    return view.where((c > F.lit(position)) & (c < F.lit(limit))).orderBy(column).limit(1)


def fixed_prefix(n: int, column: str = "key") -> Column:
    """The first n characters; keys that are shorter have none (null)."""
    return F.when(F.length(column) >= n, F.substring(column, 1, n))


def capped_prefix(n: int, column: str = "key") -> Column:
    return F.substring(column, 1, n)


def prefix_scan(view: DataFrame, prefix, column: str = "key") -> DataFrame:
    return view.where(F.col(column).startswith(F.lit(prefix)))


def first_per_prefix(view: DataFrame, prefix: Column, order: Sequence[Column]) -> DataFrame:
    """What stepping to the next prefix again and again visits: the first row of each prefix."""
    rest = F.struct(*view.columns)
    keyed = view.withColumn("_prefix", prefix)
    window = Window.partitionBy("_prefix").orderBy(*order)
    return keyed.withColumn("_at", F.row_number().over(window)).where("_at = 1").select(rest.alias("r")).select("r.*")


def multi_scan(view: DataFrame, ranges: Sequence[tuple], column: str = "key") -> DataFrame:
    """Rows of several sorted disjoint ranges [lo, hi), each with its range_id.

    The ranges are the caller's literals, so they become one expression and prune the scan.
    """
    flat = [x for r in ranges for x in r]
    if any(a > b for a, b in zip(flat, flat[1:])):
        raise ValueError("ranges must be sorted and disjoint")
    which = None
    for i, (lo, hi) in enumerate(ranges):
        inside = (F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi))
        which = F.when(inside, i) if which is None else which.when(inside, i)
    if which is None:
        return view.withColumn("range_id", F.lit(None).cast("int")).where(F.lit(False))
    any_range = (F.col(column) >= F.lit(ranges[0][0])) & (F.col(column) < F.lit(ranges[-1][1]))
    return view.where(any_range).withColumn("range_id", which).where("range_id is not null")


def all_versions(log: DataFrame, lo, hi, limit: int, column: str = "key") -> DataFrame:
    """Log rows with keys in [lo, hi], both ends in, newest version of a key first, at most ``limit``."""
    return log.where(F.col(column).between(F.lit(lo), F.lit(hi))).orderBy(column, F.desc("seq")).limit(limit)


def page(view: DataFrame, size: int, order: Sequence[str], after: Sequence | None = None) -> DataFrame:
    """A page of rows in order, beyond the last row of the page before (its order columns)."""
    if size <= 0:
        raise ValueError("a page has at least one row")
    if after is not None:
        here = F.struct(*order)
        last = F.struct(*(F.lit(v).cast(view.schema[c].dataType).alias(c) for v, c in zip(after, order, strict=True)))
        view = view.where(here > last)
    return view.orderBy(*order).limit(size)


def mvcc_scan(versions: DataFrame, ts: int, reverse: bool = False) -> DataFrame:
    """Newest version at or below a timestamp of every key, in key order; keys deleted by then have no row."""
    top = versions.where(F.col("ts") <= ts).groupBy("key").agg(F.max_by(F.struct("kind", "value", "ts"), F.struct("ts", "seq")).alias("t"))
    return scan(top.where(~F.col("t.kind").isin("DEL", "SINGLEDEL")).select("key", "t.value", "t.ts"), reverse)


def size_of(view: DataFrame, lo=None, hi=None) -> DataFrame:
    """Bytes of keys and values in a range, and rows."""
    part = between(view, lo, hi)
    n = F.octet_length(F.col("key").cast("string")) + F.octet_length(F.col("value").cast("string"))
    return part.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


def overlaps(view: DataFrame, lo, hi) -> DataFrame:
    """One row: whether any key lies in [lo, hi)."""
    return between(view, lo, hi).limit(1).agg((F.count(F.lit(1)) > 0).alias("overlaps"))


def excise(view: DataFrame, lo, hi) -> DataFrame:
    """The view without [lo, hi)."""
    return view.where((F.col("key") < F.lit(lo)) | (F.col("key") >= F.lit(hi)))


def stop_after(view: DataFrame, order: Sequence[str], until: Column) -> DataFrame:
    """Rows in order up to the first one for which ``until`` holds, that one included.

    The first stop is one small aggregate; what lies beyond it is filtered at the scan's side.
    """
    here = F.struct(*order)
    stop = view.where(until).agg(F.min(here).alias("_stop"))
    return view.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (here <= F.col("_stop"))).drop("_stop")  # one row


def concat_ranges(parts: Sequence[tuple[DataFrame, object, object]], column: str = "key") -> DataFrame:
    """Rows of parts (view, least key, largest key) whose key ranges do not overlap, in order of the ranges.

    Each part is cut to its range, so the result is a union that needs no comparison of keys.
    """
    ordered = sorted(parts, key=lambda p: p[1])
    if any(a[2] >= b[1] for a, b in zip(ordered, ordered[1:])):
        raise ValueError("the parts' ranges overlap")
    out = None
    for view, lo, hi in ordered:
        part = view.where(F.col(column).between(F.lit(lo), F.lit(hi)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no parts")
    return out


def refill(replicas: Sequence[DataFrame], n: int, order: Sequence[str], column: str = "key", kind: str = "kind", version: str = "seq") -> DataFrame:
    """The first n live rows of several replicas' newest versions: short reads are filled from beyond.

    Each replica may hold versions that another has deleted, so a limit of each replica's rows would
    fall short; the limit is taken after the versions are reconciled, as one ordered top-n.
    """
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    rest = [c for c in every.columns if c != column]
    top = every.groupBy(column).agg(F.max_by(F.struct(*rest), version).alias("_top"))
    live = top.where(~F.col(f"_top.{kind}").isin("DEL", "SINGLEDEL")).select(column, *(F.col(f"_top.{c}").alias(c) for c in rest))
    return live.orderBy(*order).limit(n)


def sort_key(kind: str, column: str = "key") -> Column:
    """A column whose order is that of a comparator: bytewise, reverse, by number, or without regard to case.

    Reverse bytewise order of text and binary is the order of the complemented bytes, ended by a
    mark above all others, so that a prefix comes after its extensions.
    """
    c = F.col(column)
    if kind == "bytewise":
        return c.cast("binary")
    if kind == "number":
        return c.cast("decimal(38,10)")
    if kind == "nocase":
        return F.lower(c)
    if kind == "reverse":
        digits = F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.concat(digits, F.lit("G"))
    raise ValueError(f"no comparator {kind}")


def may_exist(view: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that exist (exact)."""
    return keys.join(view.select("key"), "key", "left_semi")


def by_token(view: DataFrame, token: Column, lo: int, hi: int) -> DataFrame:
    """Rows with lo < token <= hi."""
    return view.withColumn("token", token).where((F.col("token") > lo) & (F.col("token") <= hi))
