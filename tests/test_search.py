"""Search for target sizes and PSNR, bands of images, and colour files decoded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions.tables import BASE_QUANT, LAYOUT, standard_codes, zigzag_order
from tessera.operators import huffman, packing, search
from tessera.operators import images as I
from tessera.sources import containers

SHAPE = "image_id int, width int, height int, content binary"


def noisy(width: int, height: int) -> bytes:
    """A structured image with pseudo-random noise."""
    state, out = 7654321, bytearray()

    def rnd():
        nonlocal state
        state = (1103515245 * state + 12345) & 0xFFFFFFFF
        return state >> 16 & 255

    for y in range(height):
        for x in range(width):
            out += bytes([(5 * x + (rnd() >> 3)) % 256, (3 * y + (rnd() >> 4)) % 256, ((x // 8) ^ (y // 8)) * 51 % 256])
    return bytes(out)


def steps(q: float) -> dict[int, list[int]]:
    scale = int(5000 if q <= 0 else 5000 / q if q < 50 else 2 * (100 - q) if q < 100 else 0)
    return {k: [max(1, min(255, (m * scale + 50) // 100)) for m in v] for k, v in BASE_QUANT.items()}


def encoded(images, mode: str, q: float) -> dict[int, bytes]:
    scans = packing.scans(I.coded(I.blocks_of(images, "rgb", mode), steps(q)), size=12).join(images.drop("content"), "image_id")
    return {r["image_id"]: bytes(r["jpeg"]) for r in containers.baseline_files(scans, steps(q), mode).collect()}


@pytest.mark.parametrize("mode", ["400", "420"])
def test_files_come_near_a_target_size(spark, mode):
    images = spark.createDataFrame([(1, 96, 64, noisy(96, 64)), (2, 35, 19, noisy(35, 19))], SHAPE)
    sizes = {k: len(x) for k, x in encoded(images, mode, 60).items()}
    goals = spark.createDataFrame([(k, float(n), 1.0, 0, 100, 75) for k, n in sizes.items()], "image_id int, target double, tolerance double, low int, high int, start int")
    found = search.searched(goals, search.size_evaluator(I.coefficients_of(images, "rgb", mode)), passes=12).collect()
    assert len(found) == 2 and all(r["passes"] <= 12 for r in found)
    for r in found:
        assert abs(len(encoded(images, mode, r["q"])[r["image_id"]]) - sizes[r["image_id"]]) < 0.03 * sizes[r["image_id"]]


def test_fitted_codes_allow_a_higher_quality(spark):
    images = spark.createDataFrame([(1, 96, 64, noisy(96, 64))], SHAPE)
    goals = spark.createDataFrame([(1, 4000.0, 1.0, 0, 100, 75)], "image_id int, target double, tolerance double, low int, high int, start int")
    plain, own = (search.searched(goals, search.size_evaluator(I.coefficients_of(images, "rgb", "420"), fitted=f)).first() for f in (False, True))
    assert own["q"] > plain["q"] and abs(own["value"] - 4000) < 100


def test_psnr_equals_that_of_whole_blocks_and_ranges_hold(spark):
    images = spark.createDataFrame([(k, 40, 24, noisy(40, 24)) for k in range(3)], SHAPE)
    rows = [(0, 30.0, 0, 100), (1, 99.0, 20, 40), (2, None, 0, 100), (7, 30.0, 0, 100)]
    goals = spark.createDataFrame([(k, t, 1.0, low, high, 75) for k, t, low, high in rows], "image_id int, target double, tolerance double, low int, high int, start int")
    out = {r["image_id"]: r for r in search.searched(goals, search.psnr_evaluator(I.coefficients_of(images, "rgb", "444"))).collect()}
    assert abs(out[0]["value"] - 30) < 0.5 and 39 < out[1]["q"] <= 40 and out[7]["value"] is None and out[2]["passes"] == 1
    coded = I.coded(I.blocks_of(images.where("image_id = 0"), "rgb", "444"), steps(out[0]["q"]))
    error, n = coded.agg(F.sum("error"), F.count("*") * 64).first()
    assert abs(out[0]["value"] - 4.3429448 * np.log(n * 65025 / error)) < 1e-9


def test_a_policy_of_its_own(spark):
    class Down(search.Bisection):
        def update(self, value):
            met = value <= F.col("target")
            return {"low": F.col("low"), "high": F.col("high"), "q": F.when(met, F.col("q")).otherwise(F.col("q") - 10), "done": met}

    goals = spark.createDataFrame([(1, 54.0), (2, 100.0)], "image_id int, target double").selectExpr("*", "1 AS tolerance", "0 AS low", "100 AS high", "90 AS start")
    out = {r["image_id"]: r for r in search.searched(goals, lambda active: active.withColumn("value", F.col("q")), Down()).collect()}
    assert (out[1]["q"], out[1]["passes"], out[2]["passes"]) == (50.0, 5, 1)


@pytest.mark.parametrize("kind,mode", Q.SAMPLED)
def test_bands_do_not_show(spark, kind, mode):
    width, height = 38, 50 if mode == "420" else 53
    raw = noisy(width, height + 30)
    own = np.frombuffer(raw, np.uint8)
    whole = I.in_units(I.planes(own, kind, mode, width, height, 0, height), mode, width, height)
    try:
        before, I.BAND = I.BAND, 1
        parts = list(I.bands(raw, kind, mode, width, height))
    finally:
        I.BAND = before
    assert len(parts) == -(-height // 16) and np.array_equal(np.concatenate([x for _, _, x in parts]), whole)


def test_unknown_layouts_and_short_contents_give_no_blocks(spark):
    rows = [(1, 8, 8, bytes(64), "gray", None), (2, 8, 8, bytes(64), "what", "444"), (3, 8, 8, bytes(64), None, None), (4, 8, 8, bytes(64), "rgb", "400"), (5, 8, 8, bytes(192), "rgb", None)]
    df = spark.createDataFrame(rows, f"{SHAPE}, kind string, mode string")
    assert [r["image_id"] for r in I.blocks_of(df, F.col("kind"), F.col("mode")).collect()] == [1]


def levels_of(jpeg: bytes, tables: dict, mode: str, units: int) -> list[list[int]]:
    """Levels (zigzag order) of all blocks of a baseline file, in scan order."""
    at = jpeg.index(b"\xff\xda")
    data = jpeg[at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big") : -2].replace(b"\xff\x00", b"\xff")
    bits, place, before, out = "".join(f"{x:08b}" for x in data), 0, {}, []

    def symbol(kind):
        nonlocal place
        end = place + 1
        while bits[place:end] not in tables[kind]:
            end += 1
        found, place = tables[kind][bits[place:end]], end
        return found

    def value(n):
        nonlocal place
        raw, place = bits[place : place + n], place + n
        return 0 if not n else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << n) + 1

    for _ in range(units):
        for comp, _, q in LAYOUT[mode]:
            block = [0] * 64
            before[comp] = block[0] = before.get(comp, 0) + value(symbol(("dc", q)))
            k = 1
            while k < 64:
                s = symbol(("ac", q))
                if s == 0:
                    break
                k += s >> 4
                if s != 0xF0:
                    block[k] = value(s & 15)
                k += 1
            out.append(block)
    assert len(bits) - place < 8 and set(bits[place:]) <= {"1"}
    return out


@pytest.mark.parametrize("mode", ["420", "444"])
def test_colour_files_decode_with_standard_and_fitted_tables(spark, mode):
    images = spark.createDataFrame([(1, 50, 35, noisy(50, 35)), (2, 96, 64, noisy(96, 64))], SHAPE)
    blocks = I.blocks_of(images, "rgb", mode)
    coded = I.coded(blocks, steps(80))
    codes = huffman.fitted_codes(I.symbol_counts(coded))
    own = {}
    for r in codes.collect():
        own.setdefault(r["image_id"], {}).setdefault((r["cls"], r["qidx"]), {})[f"{r['code']:0{r['len']}b}"] = r["sym"]
    standard = {}
    for cls, q, sym, n, code in standard_codes():
        standard.setdefault((cls, q), {})[f"{code:0{n}b}"] = sym
    sides = images.drop("content")
    plain = containers.baseline_files(packing.scans(coded, size=18).join(sides, "image_id"), steps(80), mode)
    fitted = containers.baseline_files(packing.scans(coded, codes, size=18).join(sides, "image_id"), steps(80), mode, containers.code_segments(codes))
    plain, fitted = ({r["image_id"]: bytes(r["jpeg"]) for r in df.collect()} for df in (plain, fitted))
    want = {}
    for r in blocks.orderBy("image_id", "scan_idx").collect():
        v = I.transform(np.array([r["s"]]))
        levels = I.quantised(v, np.array([steps(80)[r["qidx"]]]), 120)[0]
        want.setdefault(r["image_id"], []).append(levels[zigzag_order()].tolist())
    for k, blocks in want.items():
        units = len(blocks) // len(LAYOUT[mode])
        assert levels_of(plain[k], standard, mode, units) == blocks == levels_of(fitted[k], own[k], mode, units)
        assert len(fitted[k]) < len(plain[k])
        # the tables in the file are those that decode it
        at, read = fitted[k].index(b"\xff\xc4"), {}
        while fitted[k][at : at + 2] == b"\xff\xc4":
            head, counts, code = fitted[k][at + 4], fitted[k][at + 5 : at + 21], 0
            end = at + 2 + int.from_bytes(fitted[k][at + 2 : at + 4], "big")
            symbols = iter(fitted[k][at + 21 : end])
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    read.setdefault(("ac" if head >> 4 else "dc", head & 15), {})[f"{code:0{length}b}"] = next(symbols)
                    code += 1
                code <<= 1
            at = end
        assert read == own[k]
