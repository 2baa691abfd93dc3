"""From the log to live views: newest versions, tombstones, merges, expiry, snapshots, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds
from .spans import Bucket, covered

KEY = ["cf", "key"]


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The log as a snapshot taken at ``seq`` sees it."""
    return log.where(F.col("seq") <= seq)


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """The log without versions above a timestamp (trimmed history)."""
    return log.where(F.col("ts") <= ts)


def newest(log: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The newest row of each key. One aggregate with map-side combine, no window sort."""
    keys, order = keys or KEY, order or ["seq"]
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest))


def without_covered(log: DataFrame, ranges: DataFrame, bucket: Bucket) -> DataFrame:
    """Log rows that no newer range delete covers."""
    newer = ranges.select("start", "end", F.col("seq").alias("range_seq"))
    return covered(log, newer, bucket, how="left_anti", residual=F.col("ranges.range_seq") > F.col("points.seq"))


def expired(now: int) -> Column:
    return F.col("expire_at").isNotNull() & (F.col("expire_at") <= now)


def live(log: DataFrame, now: int | None = None) -> DataFrame:
    """(cf, key, value, seq): live values of a log without merges. Deletes and expired values go."""
    top = newest(log)
    gone = F.col("kind").isin("DEL", "SINGLEDEL")
    if now is not None:
        gone = gone | expired(now)
    return top.where(~gone).select("cf", "key", "value", "seq")


def since_base(log: DataFrame, by: list[str]) -> DataFrame:
    """Log rows from the newest SET or DEL of their group on; a group of operands only keeps them all.

    The newest ones are one partial aggregate, joined back; a hot key's rows may be split by the join.
    """
    bases = log.where("kind != 'MERGE'").groupBy(*by).agg(F.max("seq").alias("_base"))
    return log.join(bases, by, "left").where(F.col("_base").isNull() | (F.col("seq") >= F.col("_base"))).drop("_base")


def merged(log: DataFrame, fold: str | folds.Fold, includes_base: bool = True, newest: int | None = None) -> DataFrame:
    """(cf, key, value): operands newer than the last SET or DEL of their key, folded onto its value.

    A key with neither a live SET nor an operand has no row. With ``newest`` only so many of the
    newest operands of a key are folded; the others are pruned before the shuffle.
    """
    how = folds.fold(fold) if isinstance(fold, str) else fold
    kinds = ["MERGE", "SET"] if includes_base else ["MERGE"]
    kept = since_base(log, KEY).where(F.col("kind").isin(kinds))
    if newest is not None:
        at = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("seq")))
        kept = kept.withColumn("_at", at).where(F.col("_at") <= newest).drop("_at")
    return kept.groupBy(*KEY).agg(how(F.col("value"), F.col("seq")).alias("value"))


def read_as_of(log: DataFrame, ts: int, fold: str | folds.Fold) -> DataFrame:
    """(cf, key, value): what a read at a timestamp sees. Keys that are deleted then have no row."""
    return merged(as_of(log, ts), fold)


def cells(mutations: DataFrame, keys: list[str], now: int | None = None) -> DataFrame:
    """Last write wins per cell: (keys, column, value, wt) of live cells.

    ``mutations`` has (keys, column, value, wt, deleted, expire_at); column null is a row
    tombstone, which hides cells written at or before it. At equal timestamps a tombstone beats a
    value and the greater value beats the smaller.
    """
    point = F.struct("wt", F.col("deleted").cast("int").alias("d"), "value", "expire_at")
    tops = mutations.groupBy(*keys, "column").agg(F.max(point).alias("top"))
    rows = mutations.where("column is null and deleted").groupBy(*keys).agg(F.max("wt").alias("row_wt"))
    out = tops.where("column is not null").join(rows, keys, "left")
    alive = (F.col("top.d") == 0) & (F.col("row_wt").isNull() | (F.col("top.wt") > F.col("row_wt")))
    if now is not None:
        alive = alive & (F.col("top.expire_at").isNull() | (F.col("top.expire_at") > now))
    return out.where(alive).select(*keys, "column", F.col("top.value").alias("value"), F.col("top.wt").alias("wt"), F.col("top.expire_at").alias("expire_at"))


def rows_of(live_cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Live cells as rows with one column per name."""
    return live_cells.groupBy(*keys).pivot("column", columns).agg(F.first("value"))


def compact(
    log: DataFrame, gc_before: int | None = None, keep: Column | None = None, fold: str | folds.Fold | None = None,
    snapshots: tuple[int, ...] = (), ranges: DataFrame | None = None, bucket: Bucket | None = None,
) -> DataFrame:
    """The log with all that no read needs left out; reads of the newest state and of ``snapshots`` see the same.

    Snapshots cut a key's history into stripes. Of each stripe the newest SET or DEL stays with the
    operands above it; with ``fold`` (associative) they become one row: a SET on a SET or DEL, else
    one MERGE. Points that a newer range delete (start, end, seq) of their stripe covers go; the
    range deletes themselves are the caller's. Single deletes count as deletes (see
    ``cancel_single_deletes``). Tombstones of the oldest stripe older than ``gc_before`` (by ts) are
    purged. ``keep`` is a compaction filter, asked for SETs of the newest stripe: rows for which it
    is not true go, or become a DEL where older stripes may hold the key.
    """
    stripe = F.lit(0)
    for s in snapshots:
        stripe = stripe + (F.col("seq") > s).cast("int")
    rows = log.withColumn("_stripe", stripe)
    if ranges is not None:
        of_range = F.lit(0)
        for s in snapshots:
            of_range = of_range + (F.col("seq") > s).cast("int")
        newer = ranges.select("start", "end", F.col("seq").alias("range_seq"), of_range.alias("range_stripe"))
        over = (F.col("ranges.range_seq") > F.col("points.seq")) & (F.col("ranges.range_stripe") == F.col("points._stripe"))
        rows = covered(rows, newer, bucket, how="left_anti", residual=over)
    by = [*KEY, "_stripe"]
    out = since_base(rows, by)
    if fold is not None:
        how = folds.fold(fold) if isinstance(fold, str) else fold
        operand = F.when(F.col("kind").isin("SET", "MERGE"), F.col("value"))
        based, merges = F.max(F.col("kind") != "MERGE"), F.count_if(F.col("kind") == "MERGE")
        kind = F.when(based & (merges > 0), "SET").otherwise(F.max_by("kind", "seq"))
        rest = [c for c in log.columns if c not in (*KEY, "kind", "value", "seq")]
        out = out.groupBy(*by).agg(
            F.max("seq").alias("seq"), kind.alias("kind"), how(operand, F.col("seq")).alias("value"), *(F.max_by(c, "seq").alias(c) for c in rest)
        )
        out = out.withColumn("value", F.when(F.col("kind").isin("SET", "MERGE"), F.col("value")))
    if gc_before is not None:
        out = out.where(~((F.col("_stripe") == 0) & F.col("kind").isin("DEL", "SINGLEDEL") & (F.col("ts") < gc_before)))
    if keep is not None:
        gone = (F.col("kind") == "SET") & (F.col("_stripe") == len(snapshots)) & ~F.coalesce(keep, F.lit(False))
        if snapshots:
            out = out.withColumn("_gone", gone).withColumns({"kind": F.when(F.col("_gone"), "DEL").otherwise(F.col("kind")), "value": F.when(~F.col("_gone"), F.col("value"))})
        else:
            out = out.where(~gone)
    return out.select(*log.columns)


def cancel_single_deletes(log: DataFrame) -> DataFrame:
    """The log without single deletes that directly follow a SET of their key, and without those SETs.

    A key must be set at most once between single deletes: an older SET of it comes back.
    """
    single = log.where("kind = 'SINGLEDEL'").select(*KEY).distinct()
    asked = log.join(single, KEY, "left_semi")
    w = Window.partitionBy(*KEY).orderBy("seq")
    paired = asked.withColumns({"_older": F.lag("kind").over(w), "_newer": F.lead("kind").over(w)})
    cancelled = ((F.col("kind") == "SINGLEDEL") & (F.col("_older") == "SET")) | ((F.col("kind") == "SET") & (F.col("_newer") == "SINGLEDEL"))
    left = paired.where(~F.coalesce(cancelled, F.lit(False))).drop("_older", "_newer")
    return log.join(single, KEY, "left_anti").unionByName(left)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def statistics(log: DataFrame, by: list[str]) -> DataFrame:
    """Entries by group and kind, and those that are the newest version of their key. Partial aggregates only."""
    counts = log.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_latest"))
    latest = newest(log).groupBy(*by, "kind").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("n_latest"))
    return counts.unionByName(latest).groupBy(*by, "kind").agg(F.sum("n").alias("n"), F.sum("n_latest").alias("n_latest"))


def newest_first_files(files: DataFrame) -> DataFrame:
    """Newest row per key where files (``file_rank``, larger is newer) shadow older ones."""
    return newest(files, order=["file_rank", "seq"]).where(~F.col("kind").isin("DEL", "SINGLEDEL"))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a digest that does not depend on the rows' order (replica comparison)."""
    h = F.xxhash64(*columns)
    return df.agg(F.bit_xor(h).alias("digest"), F.count(F.lit(1)).alias("n"))
