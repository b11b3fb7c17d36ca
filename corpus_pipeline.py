"""The corpus pipeline: classify, deduplicate, redact, mix, pack.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and more columns; a
null text counts as empty. What becomes of them is stated at the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm import mixing, packing, pii, quality, simhash
from quillrank.llm.common import discard, keep, materialise, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the pairwise ranking, fitted on ``labels``, puts under its bar."""
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id."""
    return simhash.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of the mix; a row comes as often as it is taken, in the order of the output shards."""
    return mixing.mixed_rows(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into bins of 2048 words; each row is a piece of a document with its text and bin."""
    return packing.packed_texts(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]

#: Scores, fingerprints and draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to ``documents``, each on all that the one before it kept, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch():  # a stage's own tables go when its result is written, and so does its input
            docs = keep(materialise(stage(spark, before, sf_dir), "stage"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
