"""Search by image for the quality that gives a target size or PSNR, all images in one plan a pass.

The state is a table of one row an image. A pass evaluates the images that are still active at
their present quality, one row each, and a policy moves their states, as functions of columns;
images that have converged leave the join, so a pass reads as much as is still searched.
What is evaluated is stored once, before the search: the PSNR needs how often each absolute
coefficient stands at each position (sums, however large the image), the size needs the blocks,
each with the first coefficient of the block before, so a pass shuffles symbol counts only.

Where images are rows of bytes, `searched_images` runs all passes of an image in the task that has it.

An image that nothing can be said of (no blocks) ends with null; a null target takes the start.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.tables import BASE_QUANT, standard_codes, zigzag_order
from tessera.operators import coding, huffman
from tessera.operators import images as I
from tessera.operators.packing import code_tables
from tessera.sources.containers import header_bytes
from tessera.sources.shared import stored

#: Images searched together.
IMAGES = 256
STATE = ["image_id", "target", "tolerance", "low", "high", "q", "best", "best_q", "value", "passes", "done"]


class Bisection:
    """Halves the range of qualities; ends near the target, or when steps get shorter than `step`."""

    def __init__(self, step: float = 0.15):
        self.step = step

    def begin(self, start: Column, low: Column, high: Column) -> Column:
        """The first quality."""
        return X.clamp(start, low, high)

    def near(self, value: Column) -> Column:
        return F.abs(value - F.col("target")) < F.col("tolerance") / 100 * F.col("target")

    def update(self, value: Column) -> dict[str, Column]:
        """low, high, q and done after a value of the present q."""
        above = value > F.col("target")
        low, high = F.when(above, F.col("low")).otherwise(F.col("q")), F.when(above, F.col("q")).otherwise(F.col("high"))
        q = (low + high) / 2
        near = self.near(value)
        stay = lambda new, old: F.when(near, F.col(old)).otherwise(new)
        return {"low": stay(low, "low"), "high": stay(high, "high"), "q": stay(q, "q"), "done": near | (F.abs(q - F.col("q")) < self.step)}


def searched(images: DataFrame, evaluate: Callable[[DataFrame], DataFrame], policy=None, passes: int = 12) -> DataFrame:
    """(image_id, target, q, value, passes) of images (image_id, target, tolerance in percent, low, high, start): the nearest value found and its quality.

    evaluate: (image_id, q) -> (image_id, value). policy: begin() and update() as Bisection has them.
    """
    policy = policy or Bisection()
    number = lambda c: F.col(c).cast("double")
    low, high = F.greatest(F.lit(0.0), number("low")), F.least(F.lit(100.0), F.greatest(number("low"), number("high")))
    nothing = F.lit(None).cast("double")
    state = images.select("image_id", number("target").alias("target"), number("tolerance").alias("tolerance"), low.alias("low"), high.alias("high"), policy.begin(number("start"), low, high).alias("q"))
    state = stored(state.select("*", nothing.alias("best"), nothing.alias("best_q"), nothing.alias("value"), F.lit(0).alias("passes"), F.lit(False).alias("done")), "search")
    for _ in range(max(1, min(20, passes))):
        active, seen = state.where(~F.col("done")), Observation()
        found = evaluate(active.select("image_id", "q")).select(F.col("image_id").alias("_id"), F.col("value").cast("double").alias("_value"))
        rows = active.join(found, F.col("image_id") == F.col("_id"), "left")
        value = F.col("_value")
        new, off = policy.update(value), F.abs(value - F.col("target"))
        better = F.col("best").isNull() | (off < F.col("best"))
        rows = rows.select(
            "image_id", "target", "tolerance", new["low"].alias("low"), new["high"].alias("high"), new["q"].alias("q"),
            *[F.when(better, x).otherwise(F.col(c)).alias(c) for c, x in (("best", off), ("best_q", F.col("q")), ("value", value))],
            (F.col("passes") + 1).alias("passes"), F.coalesce(new["done"], F.lit(True)).alias("done"),
        )
        after = state.where("done").unionByName(rows).observe(seen, F.count_if(~F.col("done")).alias("active"))
        state = stored(after, "search", instead=state)
        if not seen.get["active"]:  # counted as the state is written
            break
    return state.select("image_id", "target", F.col("best_q").alias("q"), "value", "passes")


def base_step(qidx: Column, pos: Column) -> Column:
    return F.array(*[F.array(*map(F.lit, BASE_QUANT[k])) for k in sorted(BASE_QUANT)])[qidx][pos]


def magnitudes(coefficients: DataFrame) -> DataFrame:
    """(image_id, qidx, pos, a, n): how often each absolute coefficient (x16) stands at each position."""
    flat = coefficients.select("image_id", "qidx", F.posexplode("v").alias("pos", "v"))
    return flat.groupBy("image_id", "qidx", "pos", F.abs("v").alias("a")).agg(F.count("*").alias("n"))


def errors_at(magnitude: DataFrame, active: DataFrame, bias: int = 120) -> DataFrame:
    """(image_id, error, samples) of images at their q."""
    rows = magnitude.join(active.select("image_id", X.quality_scale(F.col("q")).alias("scale")), "image_id")
    step = X.scaled(base_step(F.col("qidx"), F.col("pos")), F.col("scale"))
    rows = rows.withColumn("step", step)
    error = X.squared_error(F.col("a"), F.col("step"), X.quantized(F.col("a"), F.col("step"), F.col("pos"), bias))
    return rows.groupBy("image_id").agg(F.sum(F.col("n") * error).alias("error"), F.sum("n").alias("samples"))


def psnr_evaluator(coefficients: DataFrame) -> Callable[[DataFrame], DataFrame]:
    held = stored(magnitudes(coefficients), "magnitudes")
    return lambda active: errors_at(held, active).select("image_id", X.psnr(F.col("error"), F.col("samples")).alias("value"))


def counts_of_components(coefficients: DataFrame) -> DataFrame:
    return coefficients.groupBy("image_id").agg((F.max("qidx") > 0).alias("chroma"))


def size_evaluator(coefficients: DataFrame, metadata: DataFrame | None = None, fitted: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Bytes of whole files: headers, tables and scan. metadata (image_id, app, exif, iccp, xmp): sizes of what headers carry, none by default."""
    held = stored(coefficients.select("image_id", "qidx", "v", "before"), "coefficients")
    chroma = stored(counts_of_components(held), "components")

    def evaluate(active: DataFrame) -> DataFrame:
        rows = held.join(active.select("image_id", X.quality_scale(F.col("q")).alias("scale")), "image_id")
        counts = I.counts_at(rows)
        if fitted:
            counts = stored(counts, "counts")
            codes = stored(huffman.fitted_codes(counts), "fitted")
            bits = huffman.fitted_size(counts, codes).select("image_id", "bits").join(codes.groupBy("image_id").agg(F.count("*").alias("symbols")), "image_id")
        else:
            bits = coding.coded_size(counts).withColumn("symbols", F.lit(12 + 162))
        found = bits.join(chroma, "image_id")
        sizes = [F.lit(0)] * 4
        if metadata is not None:
            found = found.join(metadata, "image_id", "left")
            sizes = [F.coalesce(F.col(c), F.lit(0)) for c in ("app", "exif", "iccp", "xmp")]
        symbols = F.col("symbols") if fitted else F.col("symbols") * F.when(F.col("chroma"), 2).otherwise(1)
        header = F.when(F.col("chroma"), header_bytes(3, symbols, *sizes)).otherwise(header_bytes(1, symbols, *sizes))
        return found.select("image_id", (header + F.col("bits") / 8).alias("value"))

    return evaluate


def scale_at(q: np.ndarray) -> np.ndarray:
    """X.quality_scale of plain numbers."""
    return np.floor(np.select([q <= 0, q < 50, q < 100], [5000.0, 5000.0 / np.where(q > 0, q, 1), 2.0 * (100 - q)], 0.0)).astype(np.int64)


def squared_errors(v: np.ndarray, before: np.ndarray, qidx: np.ndarray, scale: np.ndarray, bias: int = 120) -> np.ndarray:
    """The error of each block at its scale."""
    few, which = I.quantisers(qidx, scale)
    return (((np.abs(v) >> 4) - few[which] * np.abs(I.quantised(v, few, bias, which))) ** 2).sum(axis=1)


def coded_bits(v: np.ndarray, before: np.ndarray, qidx: np.ndarray, scale: np.ndarray, bias: int = 120) -> np.ndarray:
    """The bits of each block at its scale, with standard codes."""
    few, which = I.quantisers(qidx, scale)
    levels = I.quantised(v, few, bias, which)
    size = I.bit_length(np.abs(levels[:, 0] - I.quantised(before[:, None], few[:, :1], bias, which)[:, 0]))
    row, code = I.symbols(levels[:, zigzag_order()])
    lengths = {k: n for k, (n, _) in code_tables(standard_codes()).items()}
    dc, ac = (np.array([lengths[cls, k] for k in (0, 1)]) for cls in ("dc", "ac"))
    symbol = code >> 16
    return dc[qidx, size] + size + np.bincount(row, ac[qidx[row], symbol] + (symbol & 15), len(v)).astype(np.int64)


#: What a search measures: of the blocks, then of an image's sum, its samples and its `more`.
MEASURES = {
    "psnr": (squared_errors, lambda total, samples, more: np.where(total > 0, 4.3429448 * np.log(np.maximum(samples, 1) * 65025.0 / np.maximum(total, 1)), 99.0)),
    "size": (coded_bits, lambda total, samples, more: more + total / 8),
}
#: Coefficients that a search keeps between passes, at most; beyond it they are computed again from the bytes.
KEPT = 1 << 23


def searched_images(images: DataFrame, kind: str | Column, mode: str | Column | None, measure: str, policy: Bisection | None = None, passes: int = 12) -> DataFrame:
    """searched() by a measure of the images' own bytes, for Bisection: (image_id, target, q, value, passes) of images (image_id, width, height, content, target, tolerance, low, high, start, more).

    A task has an image as a whole, so all its passes run there: nothing is stored or shuffled. measure: "psnr",
    or "size" in bytes, of which `more` are headers.
    """
    step, (of_blocks, of_image) = (policy or Bisection()).step, MEASURES[measure]
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = I.rows_of(images, kind, mode, *map(number, ("target", "tolerance", "low", "high", "start", "more")))
    kind_of_id, passes = dict(rows.dtypes)["image_id"], max(1, min(20, passes))

    def coefficients(batch: pa.RecordBatch):
        lay, place = I.laying(["v", "before"], I.coefficients_listed), pa.array(np.arange(batch.num_rows))
        for some in lay([batch.set_column(0, "image_id", place)]):
            v = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
            yield some.column("image_id").to_numpy(), v, *(some.column(c).to_numpy().astype(np.int64) for c in ("before", "qidx"))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, IMAGES):
                batch = whole.slice(start, IMAGES)
                yield search(batch)

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        area = (pc.cast(batch.column(1), pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) * batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)).sum()
        held = list(coefficients(batch)) if 3 * area <= KEPT else None
        target, tolerance, low, high, q, more = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(6, 12))
        low, high = np.maximum(0.0, low), np.minimum(100.0, np.maximum(low, high))
        q = np.minimum(high, np.maximum(low, q))
        best, best_q, value, count, active = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int32), np.ones(n, bool)
        for _ in range(passes):
            if not active.any():
                break
            scale, total, samples = scale_at(q), np.zeros(n), np.zeros(n)
            for image, v, before, qidx in held if held is not None else coefficients(batch):
                own = np.flatnonzero(active[image])
                for at in (own[k : k + I.BATCH] for k in range(0, len(own), I.BATCH)):
                    total += np.bincount(image[at], of_blocks(v[at].astype(np.int64), before[at], qidx[at], scale[image[at]]), n)
                    samples += 64 * np.bincount(image[at], minlength=n)
            now = np.where(samples > 0, of_image(total, samples, more), np.nan)
            off, near = np.abs(now - target), np.abs(now - target) < tolerance / 100 * target
            better = active & (np.isnan(best) | (off < best))
            best, best_q, value = np.where(better, off, best), np.where(better, q, best_q), np.where(better, now, value)
            count += active
            above, moving = now > target, active & ~near
            low, high = np.where(moving & ~above, q, low), np.where(moving & above, q, high)
            new = np.where(moving, (low + high) / 2, q)
            active &= ~(near | (np.abs(new - q) < step) | np.isnan(off))
            q = new
        given = lambda x: pa.array(x, from_pandas=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), given(best_q), given(value), pa.array(count)], names=["image_id", "target", "q", "value", "passes"])

    return rows.mapInArrow(run, f"image_id {kind_of_id}, target double, q double, value double, passes int")
