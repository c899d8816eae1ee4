"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import clear, removed, run_dir, shared_dir, stored

__all__ = ["WORD", "clear", "free_name", "numbered", "removed", "run_dir", "shared_dir", "stored", "table", "word_count"]

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null.

    A text has as many words as places where a word begins: what is left after every run
    of word characters shrinks to one mark and every separator goes.
    """
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.length(marks).cast("long")


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with each row's 0-based place in the given order, without sending all rows to one task.

    A range-partitioned sort numbers rows inside each partition; the offsets added to
    them come from one count per partition, a table with as many rows as partitions.
    """
    at = "_position"
    placed = stored(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_within", F.col(at).bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_within"))
    return out.drop(at, "_part", "_within", "_offset")


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, with underscores in front until no column of that name (in any case) is there."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted
