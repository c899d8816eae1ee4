"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an
    error, as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables and files."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables and files, once results that read them are written."""
    removed(spark, run_dir(spark))


def stored(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    Cuts the lineage, outlives lost executors, is computed once however often it is read,
    and gives the planner a measured size to decide on broadcasts by. instead: a stored
    table that nothing needs once df is written; its files go.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        removed(spark, instead.stored_at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if it comes in fewer partitions than there are cores: for work whose time is computing, on small tables of few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
