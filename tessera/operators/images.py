"""Images in Arrow batches: packed samples to blocks, blocks to coefficients and symbols.

`blocks_of` lays the bytes of images out as 8x8 blocks in scan order, each image in its own
layout and mode; `coefficients_of` also transforms them, with the first coefficient of the
block before, so that nothing later has to look for it. An image is read in bands of whole
units, so beyond its bytes memory is bounded by a band. `coded` takes blocks through transform
and quantisation to their codes, one pass and one row a block, without a shuffle, and
`counts_at` takes coefficients to symbol counts at a scale of their own. A null or short
content, or an unknown layout, gives no blocks; a block that lacks samples is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.tables import BASE_QUANT, LAYOUT, zigzag_order

#: Packed layouts: places of red, green and blue, and bytes of a pixel.
PACKED = {"rgb": (0, 1, 2, 3), "rgba": (0, 1, 2, 4), "bgra": (2, 1, 0, 4)}
#: Planar layouts and the chroma mode they are coded in.
PLANAR = {"gray": "400", "nv12": "420", "nv21": "420", "yuv420": "420", "yuv444": "444"}
#: Samples of a component in a band, about.
BAND = 1 << 18
#: Blocks of a batch, at least but for the last.
BATCH = 4096
#: Images looked at together.
ROWS = 1024


def bytes_of(kind: str, mode: str, width: int, height: int) -> int:
    """Bytes of an image in a layout."""
    half = ((height + 1) // 2) * ((width + 1) // 2)
    return height * width * PACKED[kind][3] if kind in PACKED else height * width + {"400": 0, "420": 2 * half, "444": 2 * height * width}[mode]


def cut_out(raw: bytes, kind: str, mode: str, width: int, height: int, top: int, end: int) -> list[memoryview]:
    """The bytes of each plane (one of pixels, if packed) in the rows from top (even) to end."""
    view, area, across = memoryview(raw), height * width, (width + 1) // 2
    part = lambda start, low, high, wide: view[start + low * wide : start + high * wide]
    if kind in PACKED:
        return [part(0, top, end, width * PACKED[kind][3])]
    if kind == "gray":
        return [part(0, top, end, width)]
    if mode == "444":
        return [part(k * area, top, end, width) for k in range(3)]
    low, high = top // 2, (end + 1) // 2
    if kind in ("nv12", "nv21"):
        return [part(0, top, end, width), part(area, low, high, 2 * across)]
    return [part(0, top, end, width), part(area, low, high, across), part(area + across * ((height + 1) // 2), low, high, across)]


def repeated(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of rows of pieces, `have` rows each and one below the other, with each piece's last row repeated up to `want` rows."""
    at = np.arange(want.sum()) - np.repeat(np.cumsum(want) - want, want)
    return np.repeat(np.cumsum(have) - have, want) + np.minimum(at, np.repeat(have - 1, want))


def stacked_planes(pieces: list[list[memoryview]], kind: str, mode: str, width: int, rows: np.ndarray) -> list[np.ndarray]:
    """Samples less 128 of each component, at its own resolution, of pieces (as cut_out gives them) of `rows` rows each, one below the other."""
    raw = [np.frombuffer(b"".join(x), np.uint8) for x in zip(*pieces, strict=True)]
    if kind in PACKED:
        *order, size = PACKED[kind]
        band = raw[0].reshape(-1, width, size)
        r, g, b = (band[:, :, c].astype(np.int32) for c in order)
        y = (19595 * r + 38469 * g + 7471 * b + 32768 - 128 * 65536) >> 16
        if mode == "400":
            return [y]
        shift = 16
        if mode == "420":
            shift = 18
            even = repeated(rows, rows + rows % 2)
            r, g, b = (np.pad(c[even], ((0, 0), (0, width % 2)), "edge") for c in (r, g, b))
            r, g, b = (c[0::2, 0::2] + c[0::2, 1::2] + c[1::2, 0::2] + c[1::2, 1::2] for c in (r, g, b))
        middle = 1 << (shift - 1)
        return [y, (-11059 * r - 21709 * g + 32768 * b + middle) >> shift, (32768 * r - 27439 * g - 5329 * b + middle) >> shift]
    half = (width + 1) // 2
    y, *chroma = (x.astype(np.int32) - 128 for x in raw)
    if kind in ("nv12", "nv21"):
        pairs = chroma[0].reshape(-1, half, 2)
        chroma = [pairs[:, :, int(kind == "nv21")], pairs[:, :, int(kind == "nv12")]]
    return [y.reshape(-1, width), *(x.reshape(-1, half if mode == "420" else width) for x in chroma)]


def planes(raw: np.ndarray, kind: str, mode: str, width: int, height: int, top: int, end: int) -> list[np.ndarray]:
    """Samples less 128 of each component in the rows from top (even) to end, at its own resolution."""
    return stacked_planes([cut_out(raw, kind, mode, width, height, top, end)], kind, mode, width, np.array([end - top]))


def in_units(parts: list[np.ndarray], mode: str, width: int, rows: np.ndarray | int) -> np.ndarray:
    """(units, blocks of a unit, 64): blocks in scan order of pieces of `rows` rows each, one below the other, the edges of each repeated up to whole units.

    A luma block that lies outside the image takes the mean of the block before it.
    """
    side, rows = 16 if mode == "420" else 8, np.atleast_1d(rows)
    down, across = -(-rows // side), -(-width // side)
    lines = int(down.sum())
    out = np.zeros((lines * across, len(LAYOUT[mode]), 64), np.int32)
    for comp, plane in enumerate(parts):
        mine = [k for c, k, _ in LAYOUT[mode] if c == comp]
        each = 2 if len(mine) == 4 else 1
        high = plane[repeated((rows + 1) // 2 if mode == "420" and comp else rows, down * 8 * each)]
        padded = np.pad(high, ((0, 0), (0, across * 8 * each - plane.shape[1])), "edge")
        cut = padded.reshape(lines, each, 8, across, each, 8).transpose(0, 3, 1, 4, 2, 5)
        out[:, mine] = cut.reshape(lines * across, each * each, 64)
    if mode == "420":
        row = np.arange(lines) - np.repeat(np.cumsum(down) - down, down)
        right, below = np.tile(width - np.arange(across) * 16 <= 8, lines), np.repeat(np.repeat(rows, down) - row * 16 <= 8, across)
        for k, outside in ((1, right), (2, below), (3, right | below)):
            out[outside, k] = ((out[outside, k - 1].sum(axis=1) + 32) >> 6)[:, None]
    return out


def cuts(raw: bytes | None, kind: str | None, mode: str | None, width: int | None, height: int | None) -> list[tuple[int, int]]:
    """(first row, end) of an image's bands of whole units; none if bytes lack or nothing is known of the layout."""
    mode = PLANAR.get(kind, mode)
    if raw is None or not width or not height or mode not in LAYOUT or (kind not in PACKED and kind not in PLANAR) or len(raw) < bytes_of(kind, mode, width, height):
        return []
    step = 16 * max(1, BAND // (16 * width))
    return [(top, min(top + step, height)) for top in range(0, height, step)]


def bands(raw: bytes | None, kind: str | None, mode: str | None, width: int | None, height: int | None):
    """(first unit, mode, blocks as in_units gives them) of an image's bands."""
    mode = PLANAR.get(kind, mode)
    for top, end in cuts(raw, kind, mode, width, height):
        side = 16 if mode == "420" else 8
        yield top // side * -(-width // side), mode, in_units(planes(raw, kind, mode, width, height, top, end), mode, width, end - top)


def stacks(batch: pa.RecordBatch):
    """(kind, mode, width, pieces, rows, numbers, tops) of the images of a batch (…, width, height, content, kind, mode), numbered from 0.

    Images of one layout, mode and width stand one below the other, so that arrays are worked on as wholes; an
    image of several bands comes by itself, band after band.
    """
    held: dict = {}
    area: dict = {}
    for k, (width, height, raw, kind, mode) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)):
        found, mode = cuts(raw, kind, mode, width, height), PLANAR.get(kind, mode)
        key = (kind, mode, width)
        if len(found) > 1:
            for top, end in found:
                yield *key, [cut_out(raw, *key, height, top, end)], np.array([end - top]), [k], [top]
        elif found:
            held.setdefault(key, []).append((cut_out(raw, *key, height, 0, height), height, k))
            area[key] = area.get(key, 0) + width * height
            if area[key] >= BAND:
                pieces, rows, numbers = zip(*held.pop(key), strict=True)
                area[key] = 0
                yield *key, pieces, np.array(rows), numbers, [0] * len(rows)
    for key, rest in held.items():
        pieces, rows, numbers = zip(*rest, strict=True)
        yield *key, pieces, np.array(rows), numbers, [0] * len(rows)


def rows_of(images: DataFrame, kind: str | Column, mode: str | Column | None, *more: str):
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "content", text(kind).alias("kind"), text(mode).alias("mode"), *more)


def samples_listed(every: np.ndarray, comp: np.ndarray, fresh: np.ndarray, last: dict) -> list[pa.Array]:
    return [listed(every)]


def coefficients_listed(every: np.ndarray, comp: np.ndarray, fresh: np.ndarray, last: dict) -> list[pa.Array]:
    v = transform(every)
    return [listed(v.astype(np.int32)), pa.array(before_of(v[:, 0], comp, fresh, last).astype(np.int32))]


def before_of(first: np.ndarray, comp: np.ndarray, fresh: np.ndarray, last: dict) -> np.ndarray:
    """The value before each in its component; 0 for an image's first ones (fresh: numbers of images, which last goes on from)."""
    before = np.zeros(len(first), np.int64)
    for c in np.unique(comp).tolist():
        own = np.flatnonzero(comp == c)
        image, value = fresh[own], first[own]
        shifted = np.concatenate([[last[c][1] if c in last and last[c][0] == image[0] else 0], value[:-1]])
        shifted[1:][image[1:] != image[:-1]] = 0
        before[own] = shifted
        last[c] = (image[-1], int(value[-1]))
    return before


def sums_listed(every: np.ndarray, comp: np.ndarray, fresh: np.ndarray, last: dict) -> list[pa.Array]:
    return [pa.array(every.sum(axis=1, dtype=np.int32)), pa.array(every @ np.arange(1, 65, dtype=np.int32))]


def blocks_of(images: DataFrame, kind: str | Column, mode: str | Column | None = None) -> DataFrame:
    """(image_id, kind, mode, width, height, comp, qidx, scan_idx, s) of images (image_id, width, height, content).

    kind: a packed or planar layout; mode: of chroma, for packed layouts (planar ones have theirs). Either may be a column.
    """
    return laid_out(rows_of(images, kind, mode), "s array<int>", samples_listed)


def coefficients_of(images: DataFrame, kind: str | Column, mode: str | Column | None = None) -> DataFrame:
    """blocks_of, transformed: v for s, and before, the first coefficient of the block before in the same component (0 at first)."""
    return laid_out(rows_of(images, kind, mode), "v array<int>, before int", coefficients_listed)


def sums_of(images: DataFrame, kind: str | Column, mode: str | Column | None = None) -> DataFrame:
    """blocks_of, summed: for s the samples' total, and placed, their sum weighted by place from 1."""
    return laid_out(rows_of(images, kind, mode), "total int, placed int", sums_listed)


def listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


FIXED = ["image_id", "kind", "mode", "width", "height", "comp", "qidx", "scan_idx"]


def laying(names: list[str], made):
    """Batches of rows_of() to batches of blocks: FIXED and the columns of `names` that made(blocks, components, numbers of images, state) gives.

    Columns of the images beyond rows_of()'s six come last, as they are.
    """

    def joined(held: list, more: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], names=[*FIXED, *names, *more])

    def run(batches):
        held, size = [], 0
        for whole in batches:
            more = whole.schema.names[6:]
            for start in range(0, whole.num_rows, ROWS):
                batch, state = whole.slice(start, ROWS), {}
                for kind, mode, width, pieces, rows, numbers, tops in stacks(batch):
                    every = in_units(stacked_planes(pieces, kind, mode, width, rows), mode, width, rows)
                    order = np.array([(c, q) for c, _, q in LAYOUT[mode]], np.int32)
                    side, n = 16 if mode == "420" else 8, every.shape[0] * len(order)
                    across = -(-width // side)
                    each = -(-rows // side) * across * len(order)
                    comp, qidx = np.tile(order, (len(every), 1)).T
                    image = np.repeat(numbers, each)
                    low = np.array(tops) // side * across * len(order) - (np.cumsum(each) - each)
                    at = pa.array(image)
                    fixed = [batch.column(0).take(at), pa.repeat(kind, n), pa.repeat(mode, n), pa.array(np.full(n, width, np.int32)), batch.column(2).take(at)]
                    held.append([*fixed, pa.array(comp), pa.array(qidx), pa.array(np.arange(n) + np.repeat(low, each)), *made(every.reshape(-1, 64), comp, image, state), *(x.take(at) for x in batch.columns[6:])])
                    size += n
                    if size >= BATCH:  # small images share a batch
                        yield joined(held, more)
                        held, size = [], 0
        if held:
            yield joined(held, more)

    return run


def laid_out(rows: DataFrame, more: str, made) -> DataFrame:
    """Blocks of rows_of() with the columns `more`, as laying() has them."""
    run = laying([x.split()[0] for x in more.split(", ")], made)
    return rows.mapInArrow(run, f"image_id {dict(rows.dtypes)['image_id']}, kind string, mode string, width int, height int, comp int, qidx int, scan_idx long, {more}")


def samples_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole blocks, their samples)."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    sound = (sizes == 64) & column.is_valid().to_numpy(zero_copy_only=False)
    if column.flatten().null_count:
        sound &= np.array([x is not None and None not in x for x in column.to_pylist()], bool)
    at = np.nonzero(sound)[0]
    kept = column if len(at) == len(column) else column.take(pa.array(at))
    return at, kept.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64)


def transform(s: np.ndarray) -> np.ndarray:
    """64 coefficients scaled by 16 of each row of 64 samples."""
    weights = np.array([X.row_matrix(row) for row in range(8)], np.float64)
    s = s.astype(np.int64).reshape(-1, 8, 8)
    mid = X.dct_columns([s[:, y, :] for y in range(8)])
    out = np.empty((len(s), 8, 8), np.int64)
    for y in range(8):  # sums of whole numbers under 2^53, so doubles are exact
        out[:, y] = mid[y].astype(np.float64) @ weights[y].T
    return (out >> 16).reshape(-1, 64)


def quantised(v: np.ndarray, q: np.ndarray, bias: int, which=slice(None)) -> np.ndarray:
    """Levels of coefficients (x16) under steps q, both (n, 64), by the steps' reciprocals; which: the row of q of each row of v."""
    reciprocal = np.where(q == 1, 65535, (65536 + q // 2) // q)
    share = np.where((q == 1) | (np.arange(q.shape[1]) == 0), 128, bias)
    size = ((np.abs(v) + (((share * q << 4) + 128) >> 8)[which]) * reciprocal[which]) >> 20
    return np.where(v < 0, -size, size)


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(x, 0))[1].astype(np.int64)


def symbols(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the AC codes of levels (n, 64) in zigzag order: symbol x 65536 + suffix.

    16 zeros in a run are one 0xf0 of their own; 0x00 ends a block whose last level isn't the 63rd.
    """
    row, zz = np.nonzero(levels[:, 1:])
    zz = zz + 1
    value = levels[row, zz]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    run = zz - np.where(fresh, 0, np.concatenate([[0], zz[:-1]])) - 1
    size = bit_length(np.abs(value))
    own = ((run % 16 * 16 + size) << 16) + np.where(value < 0, value + (1 << size) - 1, value)
    times = run // 16 + 1
    stop = np.ones(len(levels), np.int64)
    stop[row[zz == 63]] = 0
    each = np.bincount(row, times, len(levels)).astype(np.int64) + stop
    ends = np.cumsum(each)
    code = np.full(ends[-1] if len(ends) else 0, 0xF0 << 16)
    code[ends[stop > 0] - 1] = 0
    code[np.cumsum(times) + (np.cumsum(stop) - stop)[row] - 1] = own
    return np.repeat(np.arange(len(levels)), each), code


def quantisers(qidx: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different quantisers of rows, which of them each row has) by number and scale in percent."""
    base = np.array([BASE_QUANT[k] for k in sorted(BASE_QUANT)])
    found, which = np.unique(scale.astype(np.int64) * 4 + qidx, return_inverse=True)
    return np.clip((base[found % 4] * (found // 4)[:, None] + 50) // 100, 1, 255), which


CODED = "comp int, qidx int, scan_idx long, dc int, ac array<int>, nonzero int, error long"


def coding(matrices: dict[int, list[int]], own: str | None, bias: int = 120):
    """Batches of blocks (image_id, comp, qidx, scan_idx, s; `own` of coded()) to batches of coded blocks."""
    order = np.array(zigzag_order())

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                at, s = samples_of(batch.column("s"))
                some = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
                qidx = some.column("qidx").to_numpy()
                if own == "scale":
                    few, which = quantisers(qidx, some.column("scale").to_numpy())
                elif own:
                    few, which = some.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64), slice(None)
                else:
                    few, which = np.array([matrices.get(k, [1] * 64) for k in range(max(matrices) + 1)], np.int64), qidx
                v = transform(s)
                levels = quantised(v, few, bias, which)
                error = (((np.abs(v) >> 4) - few[which] * np.abs(levels)) ** 2).sum(axis=1)
                row, code = symbols(levels[:, order])
                ac = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(s) + 1)).astype(np.int32), pa.array(code.astype(np.int32)))
                names = ["image_id", "comp", "qidx", "scan_idx"]
                yield pa.RecordBatch.from_arrays(
                    [*map(some.column, names), pa.array(levels[:, 0].astype(np.int32)), ac, pa.array((levels != 0).sum(axis=1).astype(np.int32)), pa.array(error)],
                    names=[*names, "dc", "ac", "nonzero", "error"],
                )

    return run


def coded(blocks: DataFrame, matrices: dict[int, list[int]], bias: int = 120) -> DataFrame:
    """(image_id, comp, qidx, scan_idx, dc, ac, nonzero, error) of blocks (image_id, scan_idx, s; comp and qidx, or 0).

    matrices: steps of each quantiser in natural order; or the blocks have a column `q` of
    them, or `scale`, in percent of the base matrices; dc: the level of the first coefficient; ac: see `symbols`; error: of quantisation.
    """
    zero = lambda c: F.col(c).cast("int").alias(c) if c in blocks.columns else F.lit(0).alias(c)
    own = next((c for c in ("q", "scale") if c in blocks.columns), None)
    rows = blocks.select("s", "image_id", zero("comp"), zero("qidx"), F.col("scan_idx").cast("long").alias("scan_idx"), *([own] if own else []))
    return rows.mapInArrow(coding(matrices, own, bias), f"image_id {dict(rows.dtypes)['image_id']}, {CODED}")


def coding_images(images: DataFrame, matrices: dict[int, list[int]], bias: int = 120):
    """Batches of rows_of(images) to batches of coded blocks, in one go: an image's follow each other in scan order."""
    lay, code = laying(["s"], samples_listed), coding(matrices, "scale" if "scale" in images.columns else None, bias)
    return lambda batches: code(lay(batches))


def scaled_rows(images: DataFrame, kind: str | Column, mode: str | Column | None) -> DataFrame:
    return rows_of(images, kind, mode, *(["scale"] if "scale" in images.columns else []))


def counting(bias: int = 120):
    """Batches of coefficients (image_id, qidx, v, before, scale) to batches of symbol counts."""
    order = np.array(zigzag_order())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                some = batch.slice(low, BATCH)
                qidx, before, scale = (some.column(c).to_numpy().astype(np.int64) for c in ("qidx", "before", "scale"))
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64)
                few, which = quantisers(qidx, scale)
                levels = quantised(v, few, bias, which)
                size = bit_length(np.abs(levels[:, 0] - quantised(before[:, None], few[:, :1], bias, which)[:, 0]))
                row, code = symbols(levels[:, order])
                key = some.column("image_id").dictionary_encode()
                image = key.indices.to_numpy()
                every = np.concatenate([((image * 2 + qidx) * 2) * 256 + size, ((image[row] * 2 + qidx[row]) * 2 + 1) * 256 + (code >> 16)])
                found, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [key.dictionary.take(pa.array(found // 1024)), pa.array((found // 512 % 2).astype(np.int32)), pa.array(["dc", "ac"]).take(pa.array(found // 256 % 2)), pa.array((found % 256).astype(np.int32)), pa.array(n)],
                    names=["image_id", "qidx", "cls", "sym", "n"],
                )

    return run


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("image_id", "qidx", "cls", "sym").agg(F.sum("n").alias("n"))


COUNTED = "qidx int, cls string, sym int, n long"


def counts_at(coefficients: DataFrame, bias: int = 120) -> DataFrame:
    """(image_id, qidx, cls, sym, n) of coefficients (image_id, qidx, v, before, scale): symbols at a scale, in percent of the base matrices.

    Counted inside each batch, so few rows an image are left to sum; the block before is quantised here too.
    """
    rows = coefficients.select("image_id", "qidx", "v", "before", "scale")
    return summed(rows.mapInArrow(counting(bias), f"image_id {dict(rows.dtypes)['image_id']}, {COUNTED}"))


def counts_of(images: DataFrame, kind: str | Column, mode: str | Column | None = None, bias: int = 120, together: bool = False) -> DataFrame:
    """counts_at() of images (image_id, width, height, content, scale) in one go; together: of all of them as image 0."""
    rows = scaled_rows(images, kind, mode)
    lay, count = laying(["v", "before"], coefficients_listed), counting(bias)

    def as_one(batches):
        for batch in batches:
            yield batch.set_column(0, "image_id", pa.array(np.zeros(batch.num_rows, np.int32)))

    run = (lambda batches: count(as_one(lay(batches)))) if together else (lambda batches: count(lay(batches)))
    return summed(rows.mapInArrow(run, f"image_id {'int' if together else dict(rows.dtypes)['image_id']}, {COUNTED}"))


def symbol_counts(blocks: DataFrame) -> DataFrame:
    """(image_id, qidx, cls, sym, n) of coded blocks."""
    before = Window.partitionBy("image_id", "comp").orderBy("scan_idx")
    diff = F.col("dc") - F.lag("dc", 1, 0).over(before)
    dc = blocks.select("image_id", "comp", "qidx", "scan_idx", "dc").select("image_id", "qidx", F.lit("dc").alias("cls"), X.bit_length(F.abs(diff)).cast("int").alias("sym"))
    ac = blocks.select("image_id", "qidx", F.lit("ac").alias("cls"), F.explode("ac").alias("c")).select("image_id", "qidx", "cls", F.shiftright("c", 16).alias("sym"))
    return dc.unionByName(ac).groupBy("image_id", "qidx", "cls", "sym").agg(F.count("*").alias("n"))
