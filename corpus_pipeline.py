"""The corpus pipeline: documents to packed training sequences.

Each stage takes what its predecessor kept, as a table of the columns of ``documents``,
and is written and read again before the next begins. Stages: low quality goes, one
document of each near-duplicate group stays, documents that contain a benchmark item go,
personal data is replaced by its kind, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urlrisk.llm._common import materialize
from urlrisk.llm.decontaminate import drop_contaminated
from urlrisk.llm.near_copies import keep_first
from urlrisk.llm.packing import pack
from urlrisk.llm.pii import redact_pii
from urlrisk.llm.quality import keep_good
from urlrisk.llm.registry import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity
    of 0.8 or more of five-word shingles."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in ``text`` and ``n_chars`` counted anew."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 ids."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("private", private),
    ("packing", packing),
]

#: Classifier, components, sketches and tokenizer have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
