"""The mutation log: the table from which every view of the data is derived.

A log row is ``(cf, key, seq, kind, value, ts, expire_at)``. ``seq`` orders writes; ``kind`` is one
of ``SET DEL SINGLEDEL MERGE``; ``ts`` is a caller's timestamp (as-of reads); ``expire_at`` is the
second from which the value is gone (null: never). Range deletes are rows of a second table
``(start, end, seq)`` that covers keys in [start, end).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("SET", "DEL", "SINGLEDEL", "MERGE")
COLUMNS = ("cf", "key", "seq", "kind", "value", "ts", "expire_at")


def as_log(df: DataFrame, key: Column, seq: Column, value: Column, kind: Column | str = "SET", cf: Column | str = "default", ts: Column | None = None, expire_at: Column | None = None) -> DataFrame:
    """A log from any table."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(
        lit(cf).alias("cf"),
        key.alias("key"),
        seq.cast("long").alias("seq"),
        lit(kind).alias("kind"),
        value.alias("value"),
        (seq if ts is None else ts).cast("long").alias("ts"),
        (F.lit(None) if expire_at is None else expire_at).cast("long").alias("expire_at"),
    )


@dataclass
class WriteBatch:
    """Ordered operations that get consecutive sequence numbers when they are committed."""

    cf: str = "default"
    points: list[tuple] = field(default_factory=list)
    ranges: list[tuple] = field(default_factory=list)

    def _add(self, kind: str, key, value=None, ts: int | None = None, expire_at: int | None = None, cf: str | None = None) -> WriteBatch:
        self.points.append((len(self), cf or self.cf, key, kind, value, ts, expire_at))
        return self

    def __len__(self) -> int:
        return len(self.points) + len(self.ranges)

    def put(self, key, value, ts=None, ttl=None, now=0, cf=None) -> WriteBatch:
        if ttl is not None and ttl < 0:
            raise ValueError("a TTL may not be negative")
        return self._add("SET", key, value, ts, now + ttl if ttl else None, cf)

    def delete(self, key, ts=None, cf=None) -> WriteBatch:
        return self._add("DEL", key, None, ts, None, cf)

    def single_delete(self, key, cf=None) -> WriteBatch:
        return self._add("SINGLEDEL", key, None, None, None, cf)

    def merge(self, key, operand, ts=None, cf=None) -> WriteBatch:
        return self._add("MERGE", key, operand, ts, None, cf)

    def delete_range(self, start, end) -> WriteBatch:
        self.ranges.append((start, end, len(self)))
        return self

    def commit(self, spark: SparkSession, base: int, key_type: str = "string", value_type: str = "string") -> tuple[DataFrame, DataFrame]:
        """(log rows, range rows): operation i gets sequence number base + i."""
        points = [(cf, k, base + i, kind, v, base + i if ts is None else ts, e) for i, cf, k, kind, v, ts, e in self.points]
        schema = f"cf string, key {key_type}, seq long, kind string, value {value_type}, ts long, expire_at long"
        ranges = [(a, b, base + i) for a, b, i in self.ranges]
        return spark.createDataFrame(points, schema), spark.createDataFrame(ranges, f"start {key_type}, end {key_type}, seq long")


def conflicts(writes: DataFrame, log: DataFrame, snapshot: int) -> DataFrame:
    """Keys of a transaction's tracked (cf, key) rows that were written after its snapshot.

    An optimistic commit is allowed if this is empty.
    """
    newer = log.where(F.col("seq") > snapshot).select("cf", "key")
    return writes.select("cf", "key").distinct().join(newer, ["cf", "key"], "left_semi")


def visible(log: DataFrame, snapshot: int, commits: DataFrame | None = None) -> DataFrame:
    """Log rows that a snapshot sees. With ``commits`` (seq, commit_seq) prepared rows count from
    their commit on, and rows without a commit are not seen."""
    if commits is None:
        return log.where(F.col("seq") <= snapshot)
    done = commits.where(F.col("commit_seq") <= snapshot).select("seq")
    return log.join(done, "seq", "left_semi")


def since(log: DataFrame, seq: int) -> DataFrame:
    """Changes from a sequence number on, in order."""
    return log.where(F.col("seq") >= seq).orderBy("seq")


def replay(batches: DataFrame, decide: Column) -> DataFrame:
    """Log rows that a replay applies; ``decide`` is CONTINUE, IGNORE, STOP or CORRUPTED by row.

    Everything from the first STOP or CORRUPTED row on is left out.
    """
    judged = batches.withColumn("_decision", decide)
    stop = judged.where(F.col("_decision").isin("STOP", "CORRUPTED")).agg(F.min("seq").alias("_stop"))
    return (
        judged.crossJoin(F.broadcast(stop))  # one row
        .where((F.col("_decision") == "CONTINUE") & (F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))))
        .drop("_decision", "_stop")
    )


def conditional(pending: DataFrame, view: DataFrame, condition: str, value_type: str = "long") -> DataFrame:
    """Pending writes (key, seq, value) with ``applied``: whether the condition holds on the then current row.

    ``condition`` is an SQL expression over ``current`` (null: no row) and ``value``. The writes of a
    key are tested in turn by ``seq``: one that applies is what the next one sees. A key's pending
    writes are one array; keys run side by side.
    """
    current = view.select("key", F.col("value").alias("current"))
    turns = pending.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("turns"))
    begin = "named_struct('current', current, 'out', cast(array() as array<struct<seq:bigint,applied:boolean>>))"
    holds = "coalesce(" + condition.replace("current", "acc.current").replace("value", "x.value") + ", false)"
    step = f"named_struct('current', if({holds}, cast(x.value as {value_type}), acc.current), 'out', concat(acc.out, array(named_struct('seq', x.seq, 'applied', {holds}))))"
    tested = turns.join(current, "key", "left").select(
        "key", F.explode(F.expr(f"aggregate(turns, {begin}, (acc, x) -> {step}, acc -> acc.out)")).alias("r")
    ).select("key", "r.seq", "r.applied")
    return pending.join(tested, ["key", "seq"])


def union_logs(logs: Iterable[DataFrame]) -> DataFrame:
    """Several sources as one log; a later source shadows an earlier one at equal sequence numbers."""
    out = None
    for rank, log in enumerate(logs):
        ranked = log.withColumn("file_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        raise ValueError("no logs")
    return out
