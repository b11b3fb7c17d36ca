"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import mixing, order_minhash, packing, pii, prefix_tokens, quality, simhash, slots, toxicity, vector_join
from .common import shared_dir


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op2_split_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_docs(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_docs(spark, sf_dir))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.train(docs, _labels(spark, sf_dir)))


def op5_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tokens.token_counts(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op7_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_docs(spark, sf_dir))


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the stored versions of the map: sixteen shards, and one more."""
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sixteen = slots.SlotMap.first(16)
    for version in (sixteen, sixteen.grow()):
        slots.save_map(version, spark, path)
    return slots.shard(_docs(spark, sf_dir), slots.load_map(spark, path, sixteen.version), slots.load_map(spark, path))


def op10_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)))


REGISTERED = (op1_simhash, op2_split_tree, op3_order_minhash, op4_bradley_terry, op5_prefix_tokens, op6_best_fit, op7_pigeonhole, op8_contextual_pii, op9_virtual_slots, op10_bigru)


def queries() -> dict:
    return {f.__name__: f for f in REGISTERED}


ORACLES = {
    "op7_pigeonhole": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), component AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d USING (vec_id)
""",
}


def oracle_sql() -> dict:
    return dict(ORACLES)
