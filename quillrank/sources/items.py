"""Searchable items: the row contract, its defaults, and readers for tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("primary_text", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
ITEM_COLUMNS = ITEM_SCHEMA.names


def items(df: DataFrame, id: Column, text: Column, pos: Column, primary: Column | None = None, summary: Column | None = None, group: Column | None = None, embedding: Column | None = None) -> DataFrame:  # noqa: A002
    """Map any table to items. The primary text defaults to the id, the summary to the text; ``pos`` is the arrival order.

    Spark rows have no order of their own, so the position is a column; it breaks ties. A null text is empty.
    """
    id_, body = id.cast("string"), F.coalesce(text.cast("string"), F.lit(""))
    maybe = lambda c, kind="string": (F.lit(None) if c is None else c).cast(kind)
    return df.select(
        pos.cast("long").alias("pos"),
        id_.alias("id"),
        F.coalesce(maybe(primary), id_).alias("primary_text"),
        body.alias("text"),
        F.coalesce(maybe(summary), body).alias("summary"),
        maybe(group).alias("group"),
        maybe(embedding, "array<float>").alias("embedding"),
    )


def create_items(spark: SparkSession, rows: Iterable[Mapping], start: int = 0) -> DataFrame:
    """Items from dictionaries with ``id`` and ``text`` and maybe the other fields, in the order given."""
    full = []
    for k, r in enumerate(rows):
        extra = set(r) - set(ITEM_COLUMNS)
        if extra:
            raise ValueError(f"unknown item fields: {sorted(extra)}")
        full.append((r.get("pos", start + k), r["id"], r.get("primary_text") or r["id"], r["text"], r["summary"] if r.get("summary") is not None else r["text"], r.get("group"), r.get("embedding")))
    return spark.createDataFrame(full, ITEM_SCHEMA)


def empty_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ITEM_SCHEMA)


class InvalidItems(ValueError):
    """Items that break the row contract."""


def check_items(rows: DataFrame) -> int:
    """The number of rows; ``InvalidItems`` if an id is null, a position is null or repeated, or vectors differ in length.

    Repeated positions would leave ties without an order, and vectors of another length would score 0 without a word.
    """
    size = F.size("embedding")
    got = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.countDistinct("pos").alias("places"), F.count("pos").alias("filled"),
        F.min(F.when(F.col("embedding").isNotNull(), size)).alias("low"), F.max(F.when(F.col("embedding").isNotNull(), size)).alias("high"),
    ).first()
    if got.ids < got.n:
        raise InvalidItems(f"{got.n - got.ids} of {got.n} items have no id")
    if got.filled < got.n or got.places < got.n:
        raise InvalidItems(f"{got.n} items have {got.places} distinct positions")
    if got.low != got.high:
        raise InvalidItems(f"embeddings have from {got.low} to {got.high} components")
    return got.n


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return items(df, F.col("p_partkey"), F.concat_ws(" ", "p_brand", "p_type"), F.col("p_partkey"), primary=F.col("p_name"), group=F.col("p_brand"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return items(df, F.col("doc_id"), F.col("text"), F.col("doc_id"), primary=F.col("source"), group=F.col("lang"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return items(df, F.col("page_id"), F.col("html"), F.col("page_id"), primary=F.col("url"))


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return items(df, F.concat_ws(":", "conv_id", "turn"), F.col("text"), F.col("conv_id") * 10000 + F.col("turn"), primary=F.col("role"), group=F.col("conv_id"))


def vector_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that have an embedding of the same key number, one for one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v"))
    rows = part_items(spark, sf_dir).join(vectors, "id", "left")
    return rows.select("pos", "id", "primary_text", "text", "summary", "group", F.col("v").cast("array<float>").alias("embedding"))
