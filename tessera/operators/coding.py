"""Image coding over DataFrames: samples, blocks, coefficients, symbols, tables, bits.

Shapes: pixels(image_id, y, x, r, g, b); planes(image_id, comp, y, x, s);
blocks(image_id, scan_idx, s array of 64 in natural order); coefficients
(image_id, scan_idx, pos, v) with v scaled by 16; levels(image_id, scan_idx, qidx, pos,
zz, v, q, level). A null sample makes its block null and no error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.tables import BASE_QUANT, base_quant, huffman, zigzag
from tessera.operators import images as I
from tessera.operators import sharpness as S


def replicated(planes: DataFrame, unit: int = 8) -> DataFrame:
    """planes with their last column and row repeated up to a multiple of unit.

    Only edge samples are multiplied; nothing else moves.
    """
    edge = planes.groupBy("image_id", "comp").agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    up = lambda last: F.floor((F.col(last) + unit) / unit).cast("long") * unit - 1
    span = lambda at, last: F.when(F.col(at) == F.col(last), F.sequence(F.col(at).cast("long"), up(last))).otherwise(F.array(F.col(at).cast("long")))
    out = planes.join(edge, ["image_id", "comp"]).withColumn("_x", span("x", "_w")).withColumn("_y", span("y", "_h"))
    return out.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y")).select("image_id", "comp", F.col("_y").alias("y"), F.col("_x").alias("x"), "s")


def to_planes(pixels: DataFrame, mode: str = "444") -> DataFrame:
    """YUV planes (samples less 128) of RGB pixels in mode 444, 420 (chroma of 2x2 sums) or 400."""
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    y = pixels.select("image_id", F.lit(0).alias("comp"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), X.luma(r, g, b).alias("s"))
    if mode == "400":
        return y
    if mode == "444":
        every = F.array(X.luma(r, g, b), X.chroma_u(r, g, b), X.chroma_v(r, g, b))
        rows = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.posexplode(every).alias("comp", "s"))
        return rows.select("image_id", "comp", "y", "x", "s")
    four = subsampled(pixels)
    uv = F.array(X.chroma_u(F.col("r"), F.col("g"), F.col("b"), 18), X.chroma_v(F.col("r"), F.col("g"), F.col("b"), 18))
    rows = four.select("image_id", "y", "x", F.posexplode(uv).alias("comp", "s"))
    return y.unionByName(rows.select("image_id", (F.col("comp") + 1).alias("comp"), "y", "x", "s"))


def subsampled(pixels: DataFrame) -> DataFrame:
    """Sums of r, g, b over 2x2 pixels; an odd edge counts its pixels as often as there are places."""
    cells = pixels.groupBy("image_id", F.expr("CAST(y AS BIGINT) div 2").alias("cy"), F.expr("CAST(x AS BIGINT) div 2").alias("cx"))
    sums = cells.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"])
    return sums.select("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"), *[F.floor(F.col(c) * 4 / F.col("n")).cast("int").alias(c) for c in "rgb"])


def transformed(blocks: DataFrame, samples: str = "s") -> DataFrame:
    """blocks with v: 64 coefficients scaled by 16, from the integer column and row passes.

    Arrow batches of whole blocks, as vectorised integer arithmetic: no explode, no
    shuffle. A block that is null, or lacks samples, has null coefficients.
    """
    keep = [c for c in blocks.columns if c not in (samples, "v")]

    def run(batches):
        for batch in batches:
            at, s = I.samples_of(batch.column(0))
            flat = pa.array(I.transform(s).astype(np.int32).ravel())
            out = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * 64, flat)
            if len(at) < batch.num_rows:
                place = np.full(batch.num_rows, -1)
                place[at] = np.arange(len(at))
                out = out.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], out], names=[*keep, "v"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in blocks.dtypes if c in keep), "v array<int>"])
    return blocks.select(samples, *keep).mapInArrow(run, schema)


def quantizer(spark: SparkSession, qualities: DataFrame | int, bias: int = 120) -> DataFrame:
    """(quality, qidx, pos, m, q, iq, ib, thr) for a quality or a DataFrame of qualities."""
    if isinstance(qualities, int):
        qualities = spark.range(1).select(F.lit(qualities).alias("quality"))
    q = qualities.crossJoin(F.broadcast(base_quant(spark))).withColumn("q", X.scaled(F.col("m"), X.quality_scale(F.col("quality"))))
    return q.withColumn("iq", X.reciprocal(F.col("q"))).withColumn("ib", X.rounding(F.col("q"), F.col("pos"), bias)).withColumn("thr", X.threshold(F.col("q"), F.col("pos"), bias))


def steps_at(quality: Column, qidx: Column) -> Column:
    """The 64 steps of a quantiser at a quality, in natural order."""
    base = F.array(*[F.array(*map(F.lit, BASE_QUANT[k])) for k in sorted(BASE_QUANT)])[qidx]
    return F.transform(base, lambda m: X.scaled(m, X.quality_scale(quality)))


def limited(steps: Column, limits: Column, tolerance: int = 0) -> Column:
    """Steps, none under the least that limits allow under a tolerance of 0..100 in 256ths; null limits leave them as they are."""
    least = F.zip_with(steps, limits, lambda q, m: F.greatest(q, X.least_quant(m, max(0, min(100, tolerance)))))
    return F.coalesce(least, steps)


def levels(coefficients: DataFrame, quant: DataFrame, bias: int = 120) -> DataFrame:
    """Quantised coefficients: blocks with v exploded, joined to the (at most 128-row) quantiser and scan order."""
    spark = coefficients.sparkSession
    matrix = F.broadcast(quant.select("qidx", "pos", "q").join(F.broadcast(zigzag(spark)), "pos"))
    has = coefficients if "qidx" in coefficients.columns else coefficients.withColumn("qidx", F.lit(0))
    flat = has.select("image_id", "scan_idx", "qidx", F.posexplode("v").alias("pos", "v"))
    return flat.join(matrix, ["qidx", "pos"]).withColumn("level", X.quantized(F.col("v"), F.col("q"), F.col("pos"), bias))


def run_levels(leveled: DataFrame) -> DataFrame:
    """Zero runs and sizes of the non-zero AC levels, in zigzag order of each block."""
    within = Window.partitionBy("image_id", "scan_idx").orderBy("zz")
    ac = leveled.where((F.col("level") != 0) & (F.col("zz") > 0))
    out = ac.withColumn("run", (F.col("zz") - F.lag("zz", 1, 0).over(within) - 1).cast("int"))
    return out.withColumn("size", X.bit_length(F.abs(F.col("level"))).cast("int")).withColumn("suffix", X.suffix(F.col("level")).cast("int"))


def dc_differences(leveled: DataFrame) -> DataFrame:
    """Each block's DC level less that of the block before it in its image and component."""
    by = ["image_id", "comp"] if "comp" in leveled.columns else ["image_id"]
    order = Window.partitionBy(*by).orderBy("scan_idx")
    dc = leveled.where("zz = 0").withColumn("diff", (F.col("level") - F.lag("level", 1, 0).over(order)).cast("int"))
    return dc.withColumn("size", X.bit_length(F.abs(F.col("diff"))).cast("int")).withColumn("suffix", X.suffix(F.col("diff")).cast("int"))


def coded_size(counts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Bits of each image's scan: code lengths plus suffixes (without stuffing)."""
    codes = huffman(counts.sparkSession) if codes is None else codes
    bits = F.col("n") * (F.col("len") + F.when(F.col("cls") == "dc", F.col("sym")).otherwise(F.col("sym") % 16))
    return counts.join(F.broadcast(codes), ["cls", "qidx", "sym"]).groupBy("image_id").agg(F.sum(bits).cast("long").alias("bits"))


def histogram(coefficients: DataFrame) -> DataFrame:
    """(image_id, qidx, pos, bin, n): absolute coefficients (x16, as the transform leaves them) in bins of 4, below bin 128."""
    has = coefficients if "qidx" in coefficients.columns else coefficients.withColumn("qidx", F.lit(0))
    flat = has.select("image_id", "qidx", F.posexplode("v").alias("pos", "v"))
    binned = flat.withColumn("bin", F.shiftright(F.abs("v"), 2)).where("bin < 128")
    return binned.groupBy("image_id", "qidx", "pos", "bin").agg(F.count("*").alias("n"))


def error_sums(leveled: DataFrame) -> DataFrame:
    """(image_id, error, samples, nonzero) of quantisation, all integers."""
    error = X.squared_error(F.col("v"), F.col("q"), F.col("level"))
    return leveled.groupBy("image_id").agg(F.sum(error).cast("long").alias("error"), F.count("*").alias("samples"), F.sum(F.when(F.col("level") != 0, 1).otherwise(0)).cast("long").alias("nonzero"))


def nearest(matrix: str, qidx: int = 0) -> Column:
    """(distance, quality) of a column of 64 steps in natural order: the quality 0..100 whose matrix is nearest; first wins."""
    base = F.array(*map(F.lit, BASE_QUANT[qidx]))

    def apart(quality: Column) -> Column:
        own = F.zip_with(base, matrix, lambda m, x: (x - X.scaled(m, X.quality_scale(quality))).cast("long"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x * x)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.struct(apart(k).alias("distance"), k.alias("quality"))))


def with_quality(rows: DataFrame, matrix: str) -> DataFrame:
    """rows with quality and distance of a column of 64 steps (of quantiser `qidx`, or 0), null for null.

    Files share few matrices, so each distinct one is compared with all qualities once.
    """
    qidx = F.col("qidx") if "qidx" in rows.columns else F.lit(0)
    each = rows.select(F.col(matrix).alias("_m"), qidx.alias("_k")).where("_m IS NOT NULL").distinct()
    best = each.select("_m", "_k", F.when(F.col("_k") == 0, nearest("_m", 0)).otherwise(nearest("_m", 1)).alias("_best"))
    return rows.join(best, (F.col(matrix) == F.col("_m")) & (qidx == F.col("_k")), "left").select(*rows.columns, "_best.quality", "_best.distance")


#: Weights of the offsets -7..7 in the fits of adaptive steps, a Gaussian scaled to 255.
OFFSET_WEIGHTS = dict(enumerate((1, 5, 16, 43, 94, 164, 228, 255, 228, 164, 94, 43, 16, 5, 1), -7))
#: Positions whose steps are never adapted; the trade-off where none can be fitted; the largest offsets by quantiser.
KEPT_POSITIONS, SAFE_TRADE, CAPS = (0, 1, 8), 128.0, {0: 12, 1: 1}


def adapted(histograms: DataFrame, quant: DataFrame, low: int = -12, high: int = 12) -> DataFrame:
    """Candidate steps for each position: (image_id, qidx, pos, delta, dq, distortion, rate), integer sums over bins.

    A range join of the histogram with the candidate offsets: 25 rows for each bin, summed
    at once on the map side. Steps below quant's `least` (if it has one) are no candidates.
    """
    spark = histograms.sparkSession
    deltas = spark.range(low, high + 1).select(F.col("id").cast("int").alias("delta"))
    least = F.col("least") if "least" in quant.columns else F.lit(1)
    steps = quant.select("qidx", "pos", "q", least.alias("least")).crossJoin(F.broadcast(deltas)).withColumn("dq", F.col("q") + F.col("delta")).where("dq BETWEEN least AND 255").drop("least")
    rows = histograms.join(F.broadcast(steps), ["qidx", "pos"])
    v = F.col("bin") * 4 + 2
    idq = F.floor((65536 + F.col("dq") - 1) / F.col("dq")).cast("int")
    qv = F.shiftright(v * idq + 32768, 16).cast("int")
    off = (v - qv * F.col("dq")).cast("long")
    return rows.groupBy("image_id", "qidx", "pos", "delta", "dq").agg(F.sum(F.col("n") * off * off).cast("long").alias("distortion"), F.sum(F.col("n") * X.bit_length(qv)).cast("long").alias("rate"))


def adaptive_steps(histograms: DataFrame, quant: DataFrame, caps: dict[int, int] = CAPS) -> DataFrame:
    """(image_id, qidx, pos, trade, delta, dq): the step of each position with the least distortion + trade x rate.

    Around the present steps, distortion and rate are fitted as lines in the offset, by least
    squares with Gaussian weights; the trade-off of an image and quantiser is the quotient
    of the slopes, summed over positions. Left out are the first positions, sparse ones
    (fewer counts than half the bins up to the last) and those whose distortion hardly
    correlates with the offset; they keep their steps. Sums are exact integers; ties go to
    the smaller offset, and offsets are at most the quantiser's cap.
    """
    density = histograms.groupBy("image_id", "qidx", "pos").agg(F.sum("n").alias("total"), (F.max("bin") + 1).alias("last"))
    weights = F.create_map(*[F.lit(x) for pair in OFFSET_WEIGHTS.items() for x in pair])
    w = F.coalesce(F.element_at(weights, F.col("delta")), F.lit(0)).cast("decimal(38,0)")
    x, d, r = (F.col(c).cast("decimal(38,0)") for c in ("delta", "distortion", "rate"))
    total = lambda value, name: F.sum(value.cast("decimal(38,0)")).alias(name)
    fits = adapted(histograms, quant).groupBy("image_id", "qidx", "pos").agg(
        F.collect_list(F.struct("delta", "dq", "distortion", "rate")).alias("each"),
        *(total(v, n) for v, n in ((w, "w"), (w * x, "wx"), (w * x * x, "wxx"), (w * d, "wd"), (w * d * d, "wdd"), (w * r, "wr"), (w * x * d, "wxd"), (w * x * r, "wxr"))),
    )
    double = lambda a, b, c, e: (F.col(a) * F.col(b)).cast("double") - (F.col(c) * F.col(e)).cast("double")
    fits = fits.join(density, ["image_id", "qidx", "pos"]).withColumn("cov", double("w", "wxd", "wx", "wd")).withColumn("slope", double("w", "wxr", "wx", "wr"))
    spread = double("w", "wxx", "wx", "wx") * double("w", "wdd", "wd", "wd")
    fits = fits.withColumn("used", ~F.col("pos").isin(*KEPT_POSITIONS) & (F.col("total") >= 0.5 * F.col("last")) & (F.col("cov") * F.col("cov") >= 0.5 * spread))
    over = Window.partitionBy("image_id", "qidx")
    up, down = (F.coalesce(F.sum(F.when(F.col("used"), F.col(c).cast("decimal(38,0)"))).over(over).cast("double"), F.lit(0.0)) for c in ("cov", "slope"))
    fits = fits.withColumn("trade", F.when((up > 1000) & (down < -10), F.greatest(F.lit(1.0), -up / down)).otherwise(SAFE_TRADE))
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("qidx"))
    single = lambda c: c.cast("float").cast("double")
    cost = F.transform(F.filter("each", lambda s: s["delta"] <= cap), lambda s: F.struct((single(s["distortion"]) + F.col("trade") * single(s["rate"])).cast("float").alias("cost"), s["delta"].alias("delta"), s["dq"].alias("dq")))
    now = F.filter("each", lambda s: s["delta"] == 0)[0]
    best = F.array_min(cost)
    return fits.select("image_id", "qidx", "pos", "trade", F.when(F.col("used"), best["delta"]).otherwise(F.lit(0)).alias("delta"), F.when(F.col("used"), best["dq"]).otherwise(now["dq"]).alias("dq"))


def signed_index(y: Column, u: Column, v: Column) -> Column:
    """One of 343 colour buckets of samples less 128: y + 7u + 49v, each of 7 levels."""
    bucket = lambda x: F.shiftright((x + 128) * 1542, 16)
    return bucket(y) + 7 * bucket(u) + 49 * bucket(v)


def risk_index(r: Column, g: Column, b: Column) -> Column:
    """The colour bucket of 8-bit RGB, samples clamped to 8 bits."""
    return signed_index(*(X.clamp(f(r, g, b), -128, 127) for f in (X.luma, X.chroma_u, X.chroma_v)))


def synthetic_sharpness(a: Column, b: Column) -> Column:
    """A stand-in for a measured sharpness table: a capped weighted distance of buckets, 0 on the diagonal."""
    digit = lambda v, base: F.floor(v / base).cast("int") % 7
    apart = F.abs(digit(a, 1) - digit(b, 1)) + 3 * F.abs(digit(a, 7) - digit(b, 7)) + 3 * F.abs(digit(a, 49) - digit(b, 49))
    return F.least(F.lit(62), 2 * apart)


def riskiness(pixels: DataFrame, noise: int = 4, sharpness=synthetic_sharpness) -> DataFrame:
    """(image_id, area, visited, scored, total, gray, risk, mode): how much chroma subsampling would blur.

    sharpness: a function of two bucket columns. Neighbours come by tiles, never by a whole image.
    """
    idx = pixels.select("image_id", "y", "x", risk_index(*(F.col(c).cast("int") for c in "rgb")).alias("i"))
    rows = S.tiled(idx).where("e IS NOT NULL AND s IS NOT NULL").groupBy("image_id", "i", "e", "s").agg(F.count("*").alias("n"))
    score = sharpness(F.col("i"), F.col("e")) + sharpness(F.col("i"), F.col("s")) + sharpness(F.col("e"), F.col("s"))
    return S.judged(rows.withColumn("score", score), pixels.groupBy("image_id").agg(F.count("*").alias("area")), noise)


def mirrored_scores(pixels: DataFrame, cy: Column, cx: Column, noise: int, sharpness) -> DataFrame:
    """(image_id, cy, cx, y, x, score) inside cells: neighbours right and below, or left and above at a cell's last column and row."""
    index = signed_index(*(f(*(F.col(c).cast("int") for c in "rgb")) for f in (X.luma, X.chroma_u, X.chroma_v)))
    rows = pixels.select("image_id", cy.alias("cy"), cx.alias("cx"), "y", "x", index.alias("i"))
    cell = ["image_id", "cy", "cx"]
    across, down = Window.partitionBy(*cell, "y").orderBy("x"), Window.partitionBy(*cell, "x").orderBy("y")
    rows = rows.withColumn("e", F.coalesce(F.lead("i").over(across), F.lag("i").over(across))).withColumn("s", F.coalesce(F.lead("i").over(down), F.lag("i").over(down)))
    score = sharpness(F.col("i"), F.col("e")) + sharpness(F.col("i"), F.col("s")) + sharpness(F.col("e"), F.col("s"))
    return rows.select(*cell, "y", "x", F.when(score > noise, score).otherwise(0).cast("int").alias("score"))


def block_riskiness(pixels: DataFrame, noise: int = 4, sharpness=synthetic_sharpness) -> DataFrame:
    """(image_id, cy, cx, scored, total, risk) of 8x8 blocks; risk: 0..100, from the mean of scores above the noise."""
    scores = mirrored_scores(pixels, F.expr("CAST(y AS BIGINT) div 8"), F.expr("CAST(x AS BIGINT) div 8"), noise, sharpness)
    sums = scores.groupBy("image_id", "cy", "cx").agg(F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).cast("long").alias("scored"), F.sum("score").cast("long").alias("total"))
    return sums.withColumn("risk", F.when(F.col("scored") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.col("total") / F.col("scored") * 4.0)))


def riskiness_map(pixels: DataFrame, noise: int = 4, sharpness=synthetic_sharpness) -> DataFrame:
    """(image_id, y, x, risk): min(255, 2 x score) of each pixel in a whole 7x7 tile.

    A tile is the first 7 rows and columns of an 8x8 block, so each 8th row and column is read for two tiles.
    """
    side = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    spread = lambda c: F.explode(F.when((F.col(c) > 0) & (F.col(c) % 7 == 0), F.array(F.expr(f"CAST({c} AS BIGINT) div 7 - 1"), F.expr(f"CAST({c} AS BIGINT) div 7"))).otherwise(F.array(F.expr(f"CAST({c} AS BIGINT) div 7"))))
    rows = pixels.withColumn("ty", spread("y")).withColumn("tx", spread("x"))
    scores = mirrored_scores(rows, F.col("ty"), F.col("tx"), noise, sharpness).join(side, "image_id")
    inside = scores.where("y < 7 * cy + 7 AND x < 7 * cx + 7 AND 7 * cy + 7 <= h AND 7 * cx + 7 <= w")
    return inside.select("image_id", "y", "x", F.least(F.lit(255), 2 * F.col("score")).cast("int").alias("risk"))


def error_map(a: DataFrame, b: DataFrame, on: list[str], value: str = "s") -> DataFrame:
    """min(255, 4 x absolute difference) of two images' samples."""
    pairs = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    return pairs.select(*on, F.least(F.lit(255), 4 * F.abs(F.col("_a") - F.col("_b"))).cast("int").alias("error"))
