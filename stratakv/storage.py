"""Where the engine writes what outlives a plan: the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stratakv-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/engine/{label}-{uuid.uuid4().hex}"


def export(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """A consistent copy of a DataFrame, written and read back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)
