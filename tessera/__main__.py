"""python -m tessera SOURCE OUT [options]: handles the new files of a folder (see streaming.folder)."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description="Encodes the pixmaps of a folder and reports on its images; files handled before are left out.")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--quality", type=float, default=75.0)
    p.add_argument("--mode", choices=["auto", "400", "420", "444"], default="auto")
    goal = p.add_mutually_exclusive_group()
    goal.add_argument("--size", type=float, help="target size in bytes")
    goal.add_argument("--psnr", type=float, help="target PSNR in dB")
    p.add_argument("--tolerance", type=float, default=1.0, help="of the target, in percent")
    p.add_argument("--passes", type=int, default=12)
    p.add_argument("--table", help="a fitted sharpness table (a, b, score) as Parquet")
    p.add_argument("--print", dest="shown", action="store_true", help="print the report and its matrices")
    a = p.parse_args(arguments)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tessera.streaming import folder

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    table = spark.read.parquet(a.table) if a.table else None
    folder.run(spark, a.source, a.out, folder.Options(a.quality, a.mode, a.size, a.psnr, a.tolerance, a.passes, table))
    if a.shown:
        report = spark.read.parquet(f"{a.out}/report")
        report.drop("luma", "chroma").show(truncate=False)
        each = report.select("path", "quality", F.posexplode(F.array("luma", "chroma")).alias("qidx", "m")).where("m IS NOT NULL")
        folder.printed(each, ["path", "qidx", "quality"]).orderBy("path", "qidx", "y").show(truncate=False)


if __name__ == "__main__":
    main()
