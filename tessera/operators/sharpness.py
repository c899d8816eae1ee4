"""How much chroma subsampling would blur an image: a sharpness table fitted from images, and its use.

A pixel's colour bucket and those of its right and lower neighbours make a triple. Scores are
sums over triples, so images are counted down to triples first (in their task, where an image is
one row; by tiles with a halo of one pixel, where pixels are rows), and everything after reads
counts. A table gives each pair of buckets the mean loss of chroma that was measured at pixels
with such a neighbour; it has 343 x 343 rows at most, so it is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import images as I

BUCKETS = 343
#: Side of the tiles that pixels are dealt to.
TILE = 64
#: Rows of a batch, at least but for the last.
ROWS = 1 << 15


def bucket(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One of BUCKETS of samples less 128, clamped to 8 bits."""
    level = lambda x: ((np.clip(x, -128, 127) + 128) * 1542) >> 16
    return level(y) + 7 * level(u) + 49 * level(v)


def triples_of(images: DataFrame, kind: str = "rgb") -> DataFrame:
    """(image_id, i, e, s, n, loss) of packed images: buckets of pixels, of those right and below, how often, and the chroma lost by halving."""

    names = ["image_id", "i", "e", "s", "n", "loss"]

    def joined(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                width, height, raw = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                if raw is None or not width or not height or len(raw) < I.bytes_of(kind, "444", width, height):
                    continue
                samples, step = np.frombuffer(raw, np.uint8), 2 * max(1, I.BAND // (2 * width))
                for top in range(0, height - 1, step):
                    end = min(top + step, height)
                    every = I.planes(samples, kind, "444", width, height, top, min(end + 1, height))
                    index = bucket(*every)
                    halves = I.planes(samples, kind, "420", width, height, top, end)[1:]
                    wide = [np.repeat(np.repeat(x, 2, axis=0), 2, axis=1)[: end - top, :width] for x in halves]
                    loss = sum(np.abs(a[: end - top] - b) for a, b in zip(every[1:], wide, strict=True))
                    rows = len(index) - 1
                    key = (index[:rows, :-1] * BUCKETS + index[:rows, 1:]) * BUCKETS + index[1:, :-1]
                    found, at, n = np.unique(key, return_inverse=True, return_counts=True)
                    lost = np.bincount(at.ravel(), loss[:rows, :-1].ravel(), len(found)).astype(np.int64)
                    numbers = (found // BUCKETS**2, found // BUCKETS % BUCKETS, found % BUCKETS)
                    held.append([pa.repeat(batch.column(0)[k], len(found)), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(n), pa.array(lost)])
                    size += len(found)
                    if size >= ROWS:  # small images share a batch
                        yield joined(held)
                        held, size = [], 0
        if held:
            yield joined(held)

    rows = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "content")
    parts = rows.mapInArrow(run, f"image_id {dict(rows.dtypes)['image_id']}, i int, e int, s int, n long, loss long")
    return parts.groupBy("image_id", "i", "e", "s").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def neighbours(batch: pa.RecordBatch, kind: str):
    """(numbers, i, e, s, loss) of the images of a batch (image_id, width, height, content), as arrays of pixel rows; numbers: the image of each row.

    Images of one width stand one below the other; large ones come in bands that end with the row below.
    """
    held: dict = {}

    def found(width: int, pieces: list):
        cut, rows, numbers = zip(*pieces, strict=True)
        rows = np.array(rows)
        y, u, v = I.stacked_planes(cut, kind, "444", width, rows)
        index = bucket(y, u, v).astype(np.int32)
        at = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        half = (rows + 1) // 2
        lines, columns = np.repeat(np.cumsum(half) - half, rows) + at // 2, np.arange(width) // 2
        loss = sum(np.abs(a - b[lines][:, columns]) for a, b in zip((u, v), I.stacked_planes(cut, kind, "420", width, rows)[1:], strict=True))
        own = np.flatnonzero(at < np.repeat(rows, rows) - 1)
        return np.repeat(numbers, rows - 1), index[own, :-1], index[own, 1:], index[own + 1, :-1], loss[own, :-1]

    for k, (width, height, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
        if raw is None or not width or not height or len(raw) < I.bytes_of(kind, "444", width, height):
            continue
        step = 2 * max(1, I.BAND // (2 * width))
        for top in range(0, height - 1, step):
            end = min(top + step + 1, height)
            own, area = held.setdefault(width, [[], 0])
            own.append((I.cut_out(raw, kind, "444", width, height, top, end), end - top, k))
            held[width][1] = area + width * (end - top)
            if held[width][1] >= I.BAND:
                yield found(width, held.pop(width)[0])
    for width, (rest, _) in held.items():
        yield found(width, rest)


def pair_sums(images: DataFrame, kind: str = "rgb") -> DataFrame:
    """(a, b, n, loss) of packed images: pairs of buckets beside or below each other, how often, and the chroma lost; a task has BUCKETS x BUCKETS rows at most."""

    def run(batches):
        n, lost = np.zeros(BUCKETS**2, np.int64), np.zeros(BUCKETS**2, np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, I.ROWS):
                for _, i, e, s, loss in neighbours(whole.slice(low, I.ROWS), kind):
                    for other in (e, s):
                        pair = (i * BUCKETS + other).ravel()
                        n += np.bincount(pair, minlength=BUCKETS**2)
                        lost += np.bincount(pair, loss.ravel(), BUCKETS**2).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(n[at]), pa.array(lost[at])], names=["a", "b", "n", "loss"])

    rows = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "content")
    parts = rows.mapInArrow(run, "a int, b int, n long, loss long")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))


def fitted_to(images: DataFrame, scale: int = 1, most: int = 255, kind: str = "rgb") -> DataFrame:
    """fitted() to the triples of packed images, which are summed in their tasks."""
    return scores_of(pair_sums(images, kind), scale, most)


def judged_by(images: DataFrame, table: DataFrame, kind: str = "rgb", noise: int = 4) -> DataFrame:
    """judged() of packed images, each in the task that has it, by a table of BUCKETS x BUCKETS rows at most, which goes to the tasks as an array."""
    look = np.zeros((BUCKETS, BUCKETS), np.int32)
    for a, b, score in table.select("a", "b", "score").collect():
        look[a, b] = score

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, I.ROWS):
                batch = whole.slice(low, I.ROWS)
                sums = np.zeros((4, batch.num_rows), np.int64)
                for image, i, e, s, _ in neighbours(batch, kind):
                    score = look[i, e] + look[i, s] + look[e, s]
                    loud = score > noise
                    gray = (i // 7 % 7 == 3) & (i // 49 == 3)
                    each = (np.full(len(i), i.shape[1]), loud.sum(axis=1), (score * loud).sum(axis=1), gray.sum(axis=1))
                    sums += np.stack([np.bincount(image, x, batch.num_rows).astype(np.int64) for x in each])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *map(pa.array, sums)], names=["image_id", "area", *SUMS])

    area = (F.col("width") * F.col("height")).cast("long").alias("area")
    rows = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "content", area)
    return with_verdict(rows.mapInArrow(run, f"image_id {dict(rows.dtypes)['image_id']}, area long, " + ", ".join(f"{c} long" for c in SUMS)))


def tiled(pixels: DataFrame, side: int = TILE) -> DataFrame:
    """pixels (image_id, y, x, i) with e and s, the values right and below (null at an image's end).

    Pixels go to tiles, those at a tile's first row or column to the tile before as well, so one
    shuffle by tile serves both neighbours, whatever the image's size.
    """
    at = lambda c: F.expr(f"CAST({c} AS BIGINT) div {side}")
    both = lambda c: F.explode(F.when((F.col(c) % side == 0) & (F.col(c) > 0), F.array(at(c), at(c) - 1)).otherwise(F.array(at(c))))
    rows = pixels.withColumn("ty", both("y")).withColumn("tx", both("x")).repartition("image_id", "ty", "tx")
    tile = ["image_id", "ty", "tx"]
    rows = rows.withColumn("e", F.lead("i").over(Window.partitionBy(*tile, "y").orderBy("x"))).withColumn("s", F.lead("i").over(Window.partitionBy(*tile, "x").orderBy("y")))
    return rows.where((F.col("ty") == at("y")) & (F.col("tx") == at("x"))).drop("ty", "tx")


def fitted(triples: DataFrame, scale: int = 1, most: int = 255) -> DataFrame:
    """(a, b, score): the table of pairs seen in triples: `scale` times their mean loss, floored."""
    pair = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("e").alias("b")), F.struct(F.col("i").alias("a"), F.col("s").alias("b"))))
    sums = triples.select("n", "loss", pair.alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return scores_of(sums, scale, most)


def scores_of(sums: DataFrame, scale: int, most: int) -> DataFrame:
    """(a, b, score) of sums (a, b, n, loss)."""
    return sums.select("a", "b", F.least(F.lit(most), F.floor(F.col("loss") * scale / F.col("n"))).cast("int").alias("score"))


def scored(triples: DataFrame, table: DataFrame) -> DataFrame:
    """triples with score, the sum of three look-ups; pairs that aren't in the table count nothing."""
    total = F.lit(0)
    for k, (a, b) in enumerate((("i", "e"), ("i", "s"), ("e", "s"))):
        # BUCKETS x BUCKETS rows at most
        own = F.broadcast(table.select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.col("score").alias(f"t{k}")))
        triples = triples.join(own, (F.col(a) == F.col(f"a{k}")) & (F.col(b) == F.col(f"b{k}")), "left")
        total = total + F.coalesce(f"t{k}", F.lit(0))
    return triples.withColumn("score", total).drop(*(f"{c}{k}" for c in "abt" for k in range(3)))


def judged(scores: DataFrame, areas: DataFrame, noise: int = 4) -> DataFrame:
    """(image_id, visited, scored, total, gray, area, risk, mode) of scores (image_id, i, n, score) and areas (image_id, area)."""
    gray = (F.expr("i div 7 % 7") == 3) & (F.expr("i div 49") == 3)
    loud, n = F.col("score") > noise, F.col("n")
    count = lambda hit, x: F.sum(F.when(hit, x).otherwise(0)).cast("long")
    sums = scores.groupBy("image_id").agg(F.sum("n").alias("visited"), count(loud, n).alias("scored"), count(loud, n * F.col("score")).alias("total"), count(gray, n).alias("gray"))
    rows = areas.join(sums, "image_id", "left").fillna(0, list(SUMS))  # images of one row or column visit nothing
    return with_verdict(rows)


#: Sums over an image's pixels that have both neighbours.
SUMS = ("visited", "scored", "total", "gray")


def with_verdict(rows: DataFrame) -> DataFrame:
    """rows (area, SUMS) with risk and mode."""
    risk = F.when((F.col("scored") == 0) | (F.col("scored") * 100 < F.col("area")), 0.0).otherwise(F.coalesce(F.least(F.lit(100.0), F.col("total") / F.col("scored") * 4.0), F.lit(0.0)))
    return rows.withColumn("risk", risk).withColumn("mode", mode_of(F.col("gray"), F.col("visited"), F.col("risk")))


def mode_of(gray: Column, visited: Column, risk: Column) -> Column:
    """The mode that suits: gray images have none of chroma; the higher the risk, the more of it stays."""
    return F.when((visited > 0) & (gray > 0.995 * visited), "400").when(risk < 40, "420").when(risk < 70, "sharp").otherwise("444")


def recommended(images: DataFrame, table: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """images (image_id, width, height, content) -> judged(), by their triples and a table."""
    areas = images.select("image_id", (F.col("width") * F.col("height")).cast("long").alias("area"))
    return judged(scored(triples_of(images) if triples is None else triples, table), areas)
