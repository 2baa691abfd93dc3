"""Change feeds, incremental views, running merges, expiry and windows on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import reconcile


def change_feed(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """New log rows as they are committed to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail(feed: DataFrame, from_seq: int) -> DataFrame:
    """Changes from a sequence number on."""
    return feed.where(F.col("seq") >= from_seq)


def run_available(feed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Handles what is there in micro-batches, then stops; progress is kept in ``checkpoint``."""
    feed.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class IncrementalView:
    """A view re-keyed from a feed: each batch writes its own newest rows, reads merge what was written.

    Every ``merge_every`` batches all rows so far are written as one, so a read merges a bounded
    number of folders and a batch in between costs its own rows only. A batch that is run again
    after a failure writes the same folders again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], derive: Callable[[DataFrame], DataFrame], merge_every: int = 16):
        self.spark, self.path, self.keys, self.derive, self.merge_every = spark, path.rstrip("/"), keys, derive, merge_every
        self.version = -1

    def _upto(self, epoch: int) -> DataFrame:
        """Newest rows by key of the last merged folder before or at a batch and of the batches after it."""
        last = (epoch + 1) // self.merge_every * self.merge_every - 1
        merged = [f"{self.path}/v{last}"] if last >= 0 else []
        written = [*merged, *(f"{self.path}/d{n}" for n in range(last + 1, epoch + 1))]
        return reconcile.newest(self.spark.read.parquet(*written), keys=self.keys)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Newest row of each key by ``seq``; rows of kind DEL take their key out of ``rows()``."""
        new = self.derive(batch)
        for k in self.keys:
            new = new.where(F.col(k).isNotNull())
        new = reconcile.newest(new, keys=self.keys)
        new.write.mode("overwrite").parquet(f"{self.path}/d{epoch}")
        if (epoch + 1) % self.merge_every == 0:
            every = self.spark.read.parquet(f"{self.path}/d{epoch}")
            if epoch > 0:
                every = every.unionByName(self._upto(epoch - 1))
            reconcile.newest(every, keys=self.keys).write.mode("overwrite").parquet(f"{self.path}/v{epoch}")
        self.version = epoch

    def rows(self) -> DataFrame:
        return self._upto(self.version).where("kind != 'DEL'")


def running_merge(feed: DataFrame, fold: Column) -> DataFrame:
    """A merge operator that is an aggregate, kept as running state per key (update mode)."""
    return feed.groupBy("cf", "key").agg(fold.alias("value"), F.max("seq").alias("seq"))


def unexpired(feed: DataFrame, now: int) -> DataFrame:
    """Rows that have not expired at a second."""
    return feed.where(~reconcile.expired(now))


def windowed_counts(feed: DataFrame, ts: str, size: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per event-time window with a bound for late rows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return feed.withWatermark(ts, late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"))


def with_triggers(batch: DataFrame, triggers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A batch of mutations with the mutations that triggers derive from it."""
    out = batch
    for t in triggers:
        out = out.unionByName(t(batch), allowMissingColumns=True)
    return out


def compact_folder(spark: SparkSession, source: str, target: str, schema, gc_before: int | None = None) -> None:
    """Rewrites a log folder with the newest version of each key, sorted by key."""
    log = spark.read.schema(schema).parquet(source)
    reconcile.compact(log, gc_before).repartitionByRange("cf", "key").sortWithinPartitions("cf", "key").write.parquet(target)
