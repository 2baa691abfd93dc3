"""Operator 7, exact dedup: stateful streaming deduplication over a disk-backed keyed state.

The state (Spark's disk-backed store, no watermark, so nothing ever expires) keeps for each digest
the stable identifier and the content locator (file, row in the file, length) of the row that
stays, and the number of rows. It takes in new rows as they come, can be read as a table at any
time, and lies in a folder of its own, so that later arrivals are deduplicated against all before.
Where a digest is hit more than once, full texts are fetched by their locators and compared; rows of
digests that stand for several texts are grouped by the text itself. Native: DataFrame functions
and Structured Streaming only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_broadcast, fresh, materialize, scratch_path, text_or_empty

#: Spark's class for state on disk; the settings below are its own.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Largest number of keys or locators (about 150 bytes each) that is broadcast; more are joined by sort-merge.
BROADCAST_KEYS = 300_000
#: Rows of one text beyond which its rows get the group's verdict by broadcast and not by its key.
HOT_ROWS = 1_000
#: Where a row lies.
LOCATOR = ["path", "row", "length"]


def sha256(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DedupState:
    """The keyed state of one stream of (key binary, id, locator) rows in Parquet folders, kept at ``at``."""

    def __init__(self, spark: SparkSession, schema: T.StructType, at: str | None = None, files_per_trigger: int = 10_000):
        self.spark = spark.newSession()  # its settings don't touch the caller's
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        self.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
        self.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
        # else each of many small stores takes several MB of disk for its log in advance
        self.spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
        partitions = spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", partitions)
        self.schema, self.files = schema, files_per_trigger
        self.at = at or scratch_path(spark, "dedup-state")

    def absorb(self, path: str) -> None:
        """Take in the files of ``path`` that the state has not seen yet."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(path)
        rest = [c for c in self.schema.names if c != "key"]
        state = rows.groupBy("key").agg(F.max(F.struct(*rest)).alias("keep"), F.count(F.lit(1)).alias("size"))
        (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", self.at)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def table(self) -> DataFrame:
        """The state: key, keep_id, the other columns of the row that stays as keep_..., size."""
        state = self.spark.read.format("statestore").load(self.at)
        rest = [c for c in self.schema.names if c != "key"]
        return state.select("key.key", *(F.col(f"value.max.{c}").alias(f"keep_{c}") for c in rest), F.col("value.count").alias("size"))


def located(docs: DataFrame) -> DataFrame:
    """The documents as rows of files: as they are where they are read from files, else written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return materialize(docs, "dedup-documents")


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(key, id, path, row, length, text) of documents that are rows of files."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"),
        F.octet_length(text).cast("long").alias("length"), text.alias("text"),
    )
    return rows.select(digest(F.col("text")).alias("key"), "id", *LOCATOR, "text")


def judged(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], state: str | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, groups, apart) of located documents, all written.

    rows: (key, id, locator) of the documents; groups: the state's rows of digests; apart: (locator,
    keep_..., size) of all rows whose digest stands for several texts, grouped by the text.
    """
    spark = docs.sparkSession
    base = state.rstrip("/") if state else scratch_path(spark, "dedup-state")
    found = _rows(docs, id_col, text_col, digest)
    arrivals, arrival = f"{base}/rows", f"{base}/rows/arrival={uuid.uuid4().hex}"
    rows = found.drop("text")
    rows.write.parquet(arrival)
    kept = DedupState(spark, rows.schema, f"{base}/state")
    kept.absorb(f"{arrivals}/*")
    groups = materialize(kept.table(), "dedup-table")
    rows = spark.read.schema(rows.schema).parquet(arrival)
    every = spark.read.schema(rows.schema).parquet(f"{arrivals}/*") if state else rows

    # full texts of all rows of digests with more than one row, fetched by their locators
    hits = bounded_broadcast(groups.where("size > 1").select("key"), BROADCAST_KEYS)
    asked = every.join(hits, "key", "left_semi").select("key", "id", *LOCATOR)
    if state:
        asked = materialize(asked, "dedup-hits")
        files = [r.path for r in asked.select("path").distinct().collect()]  # names of files, not rows
        source = _rows(spark.read.parquet(*files), id_col, text_col, digest) if files else found
        few = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        texts = source.drop("key", "id", "length").join(F.broadcast(asked) if few else asked, ["path", "row"]).select("key", "id", *LOCATOR, "text")
    else:  # all of them are among the documents: one pass that reads only the files that hold them
        texts = found.join(hits, "key", "left_semi")
    collided = materialize(
        texts.select("key", "text").distinct().groupBy("key").count().where("count > 1").select("key"), "dedup-collided"
    )
    none = collided.isEmpty()
    several = texts.join(bounded_broadcast(collided, BROADCAST_KEYS), "key", "left_semi") if not none else texts.limit(0)
    same = several.groupBy("key", "text").agg(F.max(F.struct("id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("size"))
    apart = several.join(same, ["key", "text"]).select(
        *LOCATOR, *(F.col(f"keep.{c}").alias(f"keep_{c}") for c in ("id", *LOCATOR)), "size", "key", "text"
    )
    return rows, groups, apart if none else materialize(apart, "dedup-apart")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None
) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, key.

    Rows are equal if their texts are identical; null counts as empty. Of equal texts the row with
    the largest id stays (null ids are smallest); of repeated rows with that id exactly one stays.
    With ``state`` (a folder that all machines share) rows count together with all that came to that
    folder before, and are kept there; those rows' files must still be there, with the same columns.
    An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows, groups, apart = judged(located(docs), id_col, text_col, digest, state)
    hot = bounded_broadcast(groups.where(F.col("size") > HOT_ROWS), BROADCAST_KEYS)
    cold = groups.where(F.col("size") <= HOT_ROWS)
    known = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key"))
    stays = (F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row"))
    out = known
    if not apart.isEmpty():
        own = apart.drop("length", "key").withColumnRenamed("text", "own")
        names = [c for c in known.columns if c.startswith("keep_") or c == "size"]
        both = known.join(own.withColumnsRenamed({c: f"own_{c}" for c in names}), ["path", "row"], "left")
        pick = {c: F.when(F.col("own_size").isNotNull(), F.col(f"own_{c}")).otherwise(F.col(c)) for c in names}
        whole = F.when(F.col("own_size").isNotNull(), F.concat("key", F.col("own").cast("binary"))).otherwise(F.col("key"))
        out = both.select("id", "path", "row", *(v.alias(c) for c, v in pick.items()), whole.alias("key"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), stays.alias("kept"), "key")


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. See ``dedup``.

    Only keys of groups of two or more rows travel; texts of single rows are never shuffled as
    long as those keys can be broadcast. The row that stays is the one at the group's locator.
    """
    docs = located(docs)
    _, groups, apart = judged(docs, id_col, text_col, digest, state)
    marks = materialize(groups.where("size > 1").select("key", "keep_path", "keep_row"), "dedup-groups")
    whole, path, row, key = fresh(docs, "whole", "path", "row", "key")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row),
        digest(text_or_empty(text_col)).alias(key),
    ).select(F.col(whole).alias("whole"), F.col(path).alias("path"), F.col(row).alias("row"), F.col(key).alias("key"))
    stay = packed.join(bounded_broadcast(marks, BROADCAST_KEYS), "key", "left")
    keeps = F.col("keep_path").isNull() | ((F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row")))
    if not apart.isEmpty():
        own = apart.select("path", "row", ((F.col("path") == F.col("keep_path")) & (F.col("row") == F.col("keep_row"))).alias("own_keeps"))
        stay = stay.join(own, ["path", "row"], "left")
        keeps = F.coalesce("own_keeps", keeps)
    return stay.where(keeps).select("whole.*")
