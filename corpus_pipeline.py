"""A training corpus from ``documents``: five stages, each one operator, each written before the next.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the rows that
stay, with the columns of documents; the last one returns their segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratakv.llm import decontamination, exact_dedup, minhash, quality, sentencepiece_sampling
from stratakv.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.drop_near_duplicates(docs, weights="count")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the documents that are left."""
    encoded = sentencepiece_sampling.encode(docs, keep=["doc_id"])
    return sentencepiece_sampling.contract(encoded)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: The classifier, the similarity classes and the sampled segmentations are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
