"""Corpus pipeline: documents to tokens, each stage one operator over all its predecessor kept.

Defined cases, for every stage: a null text is an empty one (the quality stage rejects both); very long texts are read whole; equal
rows and ties are treated alike, and where one of several must be taken the choice follows all their columns; an empty table gives an
empty table; further columns are kept, whatever their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm import bpe, mixing, pii, quality, simhash
from aerolake.llm.common import free_name, new_folder, text_or_empty

#: SQL cannot express fingerprints, the trained classifier, Newton steps or merges; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; columns named like a measure stay as they are."""
    added = {f.name for f in quality.FIELDS} | {"base_failed", "kept"}
    own = {c: free_name(docs, f"_{c}") for c in docs.columns if c.lower() in added}
    judged = quality.quality(docs.withColumnsRenamed(own).withColumn("text", text_or_empty()), quality.read_labels(spark, sf_dir), keep_text=True)
    return judged.filter("kept").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row a copy."""
    return bpe.digest(bpe.round_trip(docs.select("doc_id", text_or_empty().alias("text"))))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
