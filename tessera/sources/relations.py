"""Byte relations over stored tables: a sequence of symbols 0..255 for each ``img``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, i, v: each user's event values in the order of their ids."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("img"), F.col("event_id").cast("long").alias("event_id"), (F.floor("value") % 256).cast("int").alias("v")
    )
    return numbered(events, "img", "event_id", "i").select("img", "i", "v")


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, syms: each vector's 64 elements as one 8 x 8 block, in row order."""
    level = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("img"), F.transform("embedding", level).alias("syms"))


def px_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, data: the bytes of each document."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("img"), text.alias("data"))
