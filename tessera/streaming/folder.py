"""The command-line work as a streaming job over a growing folder: each file is handled once.

Pixmaps are encoded, images are reported. A run takes what has arrived since the one before (an
available-now trigger with a checkpoint) and ends; a batch that is repeated replaces its report
and adds files under the same names. Encoding has one plan for all images of a batch: the mode is
a column (given, or by each image's own risk), the quality too (given, or searched for a size or
PSNR by image).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import coding, packing, search, sharpness
from tessera.operators import images as I
from tessera.sources import containers, files, metadata
from tessera.sources.shared import stored

INPUT = "path string, modificationTime timestamp, length long, content binary"
REPORT = "path string, kind string, width int, height int, components int, is_420 boolean, quality int, luma array<int>, chroma array<int>, n_exif long, crc_exif long, n_xmp long, crc_xmp long, n_iccp long, crc_iccp long"


@dataclass
class Options:
    """mode: 400, 420, 444 or auto (by `table`, a sharpness table). size or psnr: a target that the quality is searched for."""

    quality: float = 75.0
    mode: str = "auto"
    size: float | None = None
    psnr: float | None = None
    tolerance: float = 1.0
    passes: int = 12
    table: DataFrame | None = None


def synthetic_table(spark: SparkSession) -> DataFrame:
    """The stand-in where no table was fitted, 343 x 343 rows."""
    pairs = spark.range(sharpness.BUCKETS**2).select((F.col("id") / sharpness.BUCKETS).cast("int").alias("a"), (F.col("id") % sharpness.BUCKETS).cast("int").alias("b"))
    return pairs.withColumn("score", coding.synthetic_sharpness(F.col("a"), F.col("b")))


def report(batch: DataFrame) -> DataFrame:
    """REPORT of (path, content): what headers say, the quality of the luma matrix, sizes and CRCs of metadata."""
    known = batch.select("path", containers.kind(F.col("content")).alias("kind"), "content")
    facts = coding.with_quality(containers.inspected(known.select("path", "kind", "content"), "content").drop("content"), "luma").drop("distance", "dqt")
    jpeg = metadata.metadata_of(known.where("kind = 'JPG'"), "content", "path").select("path", "exif", F.concat("xmp", F.coalesce("extended", F.unhex(F.lit("")))).alias("xmp"), "iccp")
    png = metadata.png_metadata(known.where("kind = 'PNG'"), "content", "path").select("path", "exif", "xmp", "iccp")
    found = jpeg.unionByName(png)
    own = found.select("path", *[x for c in ("exif", "xmp", "iccp") for x in (F.octet_length(c).cast("long").alias(f"n_{c}"), F.crc32(c).alias(f"crc_{c}"))])
    return facts.join(own, "path", "left").select(*(x.split()[0] for x in REPORT.split(", ")))


def pixmaps(batch: DataFrame) -> DataFrame:
    """(image_id: the path, width, height, content: samples) of the pixmaps among (path, content)."""
    return metadata.pixmaps(batch.select("path", "content"), key="path").withColumnRenamed("path", "image_id")


def encoded(images: DataFrame, options: Options) -> DataFrame:
    """(image_id, mode, q, jpeg) of RGB images (image_id, width, height, content)."""
    spark = images.sparkSession
    if options.mode == "auto":
        risks = sharpness.recommended(images, options.table or synthetic_table(spark))
        chosen = images.join(risks.select("image_id", F.when(F.col("mode") == "sharp", "420").otherwise(F.col("mode")).alias("mode")), "image_id")
    else:
        chosen = images.withColumn("mode", F.lit(options.mode))
    chosen = stored(chosen, "chosen")
    if options.size is None and options.psnr is None:
        goals = chosen.select("image_id", "mode", F.lit(float(options.quality)).alias("q"))
    else:
        target = options.size if options.size is not None else options.psnr
        coefficients = I.coefficients_of(chosen, "rgb", F.col("mode"))
        evaluate = search.size_evaluator(coefficients) if options.size is not None else search.psnr_evaluator(coefficients)
        start = chosen.select("image_id", *[F.lit(float(x)).alias(c) for c, x in (("target", target), ("tolerance", options.tolerance), ("low", 0), ("high", 100), ("start", options.quality))])
        goals = search.searched(start, evaluate, passes=options.passes).select("image_id", "q").join(chosen.select("image_id", "mode"), "image_id")
    goals = stored(goals, "goals")
    blocks = I.blocks_of(chosen, "rgb", F.col("mode")).join(goals.select("image_id", "q").withColumn("scale", X.quality_scale(F.col("q"))).drop("q"), "image_id")
    coded = stored(I.coded(blocks, {}), "coded")
    scans = packing.scans(coded).join(goals, "image_id").join(chosen.select("image_id", "width", "height"), "image_id")
    return containers.files_of(scans).select("image_id", "mode", "q", "jpeg")


def handled(batch: DataFrame, number: int, out: str, options: Options) -> None:
    """One batch: its report, and its encoded pixmaps, under `out`."""
    batch = stored(batch.select("path", "content"), "batch")
    report(batch).write.mode("overwrite").parquet(f"{out}/report/batch={number}")
    images = pixmaps(batch)
    made = encoded(images, options)
    name = F.regexp_replace(F.element_at(F.split("image_id", "/"), -1), r"\.[^.]*$", "")
    files.register(batch.sparkSession)
    made.select(F.concat(name, F.lit(f"-{number}.jpg")).alias("name"), F.col("jpeg").alias("content")).write.format("tessera_files").mode("append").save(f"{out}/images")


def run(spark: SparkSession, source: str, out: str, options: Options | None = None, files_per_batch: int = 10_000) -> None:
    """Handles the files of a folder that no run before has handled."""
    stream = spark.readStream.format("binaryFile").schema(INPUT).option("maxFilesPerTrigger", files_per_batch).load(source)
    options = options or Options()
    query = stream.writeStream.foreachBatch(lambda batch, number: handled(batch, number, out, options)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def printed(matrices: DataFrame, keys: list[str], steps: str = "m") -> DataFrame:
    """(keys, y, x0 … x7): matrices as eight rows of eight columns."""
    flat = matrices.select(*keys, F.posexplode(steps).alias("pos", "q")).select(*keys, F.expr("pos div 8").cast("int").alias("y"), F.concat(F.lit("x"), (F.col("pos") % 8).cast("string")).alias("x"), "q")
    return flat.groupBy(*keys, "y").pivot("x", [f"x{k}" for k in range(8)]).agg(F.max("q"))
