"""Bounded, repeatable samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``per_class`` labelled documents of each class, none of them held out.

    The ids are chosen from ``labels`` by the order of a hash, so the choice doesn't depend on partitioning; only they are
    sent to the documents (at most 2 * ``per_class`` ids are broadcast). Null labels and ids are left out; of rows with
    one id, the label is the largest and the text the least, so that an id that many rows share stays one row.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("_h", F.xxhash64(F.lit(3), "doc_id"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("_h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return kept.join(F.broadcast(chosen.drop("_h")), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
