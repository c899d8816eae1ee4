"""Images, blocks and byte strings out of the shared tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, scan_idx, s): one vector is an 8x8 block of samples, one label an image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sample = lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x * 256).cast("int")))
    return rows.select(F.col("label").alias("image_id"), F.col("vec_id").alias("scan_idx"), F.transform("embedding", sample).alias("s"))


def pixels(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """(image_id, y, x, r, g, b): one image of the given width out of the events."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.lit(0).alias("image_id"),
        F.expr(f"event_id div {width}").alias("y"),
        (F.col("event_id") % width).alias("x"),
        (F.col("user_id") * 17 % 256).cast("int").alias("r"),
        (F.col("event_id") * 7 % 256).cast("int").alias("g"),
        (F.floor("value") % 256).cast("int").alias("b"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): texts as bytes."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content"))
