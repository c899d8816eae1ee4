"""Image-coding operators against SQL, plain Python and their own inverse."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import expressions as X
from tessera.functions.tables import standard_codes, zigzag_order
from tessera.operators import coding as C
from tessera.sources import containers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(repr, map(tuple, got.select(*names).collect())))
    assert rows == sorted(map(repr, want.fetchall()))


def test_zigzag_is_a_permutation():
    assert sorted(zigzag_order()) == list(range(64))
    assert zigzag_order()[:6] == [0, 1, 8, 16, 9, 2]


def test_standard_codes_are_prefix_free():
    for cls in ("dc", "ac"):
        for which in (0, 1):
            codes = [f"{c:0{n}b}" for kind, q, _, n, c in standard_codes() if (kind, q) == (cls, which)]
            assert not any(a != b and b.startswith(a) for a in codes for b in codes)
            assert len(codes) == len(set(codes)) == (12 if cls == "dc" else 162)


def test_transform_is_near_the_exact_one(spark):
    s = [(7 * y * y + 13 * x * y + 29 * x) % 256 - 128 for y in range(8) for x in range(8)]
    v = C.transformed(spark.createDataFrame([(0, 0, s)], "image_id int, scan_idx int, s array<int>")).first()["v"]

    def exact(u, w):
        c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
        return 16 * 0.25 * c(u) * c(w) * sum(s[8 * y + x] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * w * math.pi / 16) for y in range(8) for x in range(8))

    assert max(abs(v[8 * u + w] - exact(u, w)) for u in range(8) for w in range(8)) < 8


def test_null_samples_give_null_colours(spark):
    df = spark.createDataFrame([(None, 1, 2), (255, 0, 0)], "r int, g int, b int")
    rows = df.select(X.luma(F.col("r"), F.col("g"), F.col("b")).alias("y"), X.chroma_v(F.col("r"), F.col("g"), F.col("b")).alias("v")).collect()
    assert rows[0]["y"] is None and rows[1]["v"] == 128


def test_replication_repeats_edges(spark):
    rows = [(0, 0, y, x, 10 * y + x) for y in range(3) for x in range(5)]
    out = C.replicated(spark.createDataFrame(rows, "image_id int, comp int, y long, x long, s int")).collect()
    assert len(out) == 64
    assert all(r["s"] == 10 * min(r["y"], 2) + min(r["x"], 4) for r in out)


def decoded(jpeg: bytes, own: list | None = None) -> list[list[int]]:
    """Levels of each block (zigzag order) of a gray baseline file."""
    at = jpeg.index(b"\xff\xda")
    data = jpeg[at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big") : -2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{x:08b}" for x in data)
    tables = {k: {f"{c:0{n}b}": s for kind, q, s, n, c in own or standard_codes() if kind == k and q == 0} for k in ("dc", "ac")}
    height = int.from_bytes(jpeg[jpeg.index(b"\xff\xc0") + 5 :][:2], "big")
    place, out, before = 0, [], 0

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

    for _ in range(height // 8):
        block = [0] * 64
        before += value(symbol("dc"))
        block[0], k = before, 1
        while k < 64:
            s = symbol("ac")
            if s == 0:
                break
            k += s >> 4
            if s != 0xF0:
                block[k] = value(s & 15)
            k += 1
        out.append(block)
    assert len(bits) - place < 8 and set(bits[place:]) <= {"1"}
    return out


def test_files_decode_to_their_levels(spark):
    leveled = Q.leveled(spark, SF)
    want = {}
    for r in leveled.select("image_id", "scan_idx", "zz", "level").collect():
        want.setdefault(r["image_id"], {}).setdefault(r["scan_idx"], [0] * 64)[r["zz"]] = r["level"]
    files = containers.gray_files(Q.coded(spark, SF), Q.matrices(Q.QUALITY)).collect()
    assert {r["image_id"] for r in files} == set(want)
    for r in files:
        assert decoded(bytes(r["jpeg"])) == [b for _, b in sorted(want[r["image_id"]].items())]


def test_long_files_are_laid_out_in_rows(spark):
    leveled = Q.leveled(spark, SF)
    want = {}
    for r in leveled.select("image_id", "scan_idx", "zz", "level").collect():
        want.setdefault(r["image_id"], {}).setdefault(r["scan_idx"], [0] * 64)[r["zz"]] = r["level"]
    files = containers.gray_files(Q.coded(spark, SF), Q.matrices(Q.QUALITY), most=4).collect()
    assert {r["image_id"] for r in files} == set(want) and any(len(b) > 4 for b in want.values())
    for r in files:
        jpeg, blocks = bytes(r["jpeg"]), [b for _, b in sorted(want[r["image_id"]].items())]
        at = jpeg.index(b"\xff\xc0") + 5
        height, width = int.from_bytes(jpeg[at : at + 2], "big"), int.from_bytes(jpeg[at + 2 : at + 4], "big")
        assert height <= 32 and 0 <= height * width // 64 - len(blocks) < width // 8
        column = jpeg[:at] + (height * width // 8).to_bytes(2, "big") + jpeg[at + 2 :]
        assert decoded(column) == blocks + [[blocks[-1][0]] + [0] * 63] * (height * width // 64 - len(blocks))


def test_files_with_fitted_tables_decode_to_the_same_levels(spark):
    from tessera.operators import huffman as H
    from tessera.operators import images as I

    blocks = Q.coded(spark, SF)
    codes = H.fitted_codes(I.symbol_counts(blocks)).cache()
    tables = {}
    for r in codes.collect():
        tables.setdefault(r["image_id"], []).append((r["cls"], r["qidx"], r["sym"], r["len"], r["code"]))
    plain = {r["image_id"]: bytes(r["jpeg"]) for r in containers.gray_files(blocks, Q.matrices(Q.QUALITY)).collect()}
    fitted = {r["image_id"]: bytes(r["jpeg"]) for r in containers.gray_files(blocks, Q.matrices(Q.QUALITY), codes=codes).collect()}
    assert set(plain) == set(fitted)
    for k, jpeg in fitted.items():
        assert len(jpeg) < len(plain[k]) and decoded(jpeg, tables[k]) == decoded(plain[k])
        at, read = jpeg.index(b"\xff\xc4"), {}
        for cls in ("dc", "ac"):
            counts, code = jpeg[at + 5 : at + 21], 0
            symbols = iter(jpeg[at + 21 : at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")])
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    read[cls, next(symbols)] = (length, code)
                    code += 1
                code <<= 1
            at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        assert read == {(c, s): (n, x) for c, _, s, n, x in tables[k]}


def test_scans_do_not_depend_on_slices_or_batches(spark):
    from tessera.operators import packing

    read = lambda **how: {r["image_id"]: bytes(r["scan"]) for r in packing.scans(Q.coded(spark, SF), **how).collect()}
    whole = read()
    assert any(b"\xff\x00" in x for x in whole.values())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for size in (1, 2, 7, 50):
            assert whole == read(size=size)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = {r["image_id"]: (r["n_bytes"], r["n_ff"]) for r in packing.scan_sizes(Q.coded(spark, SF), size=2).collect()}
    assert sizes == {k: (len(x), x.count(b"\xff\x00")) for k, x in whole.items()}


def test_broken_blocks_and_images_are_left_out(spark):
    from tessera.operators import images as I

    rows = [(1, 0, [1] * 64), (1, 1, None), (1, 2, [None] * 64), (1, 3, [1] * 63), (2, 0, None)]
    out = I.coded(spark.createDataFrame(rows, "image_id int, scan_idx int, s array<int>"), Q.matrices(50)).collect()
    assert [(r["image_id"], r["scan_idx"], r["ac"]) for r in out] == [(1, 0, [0])]
    images = [(1, 8, 8, b"x" * 63), (2, None, 8, b"x" * 64), (3, 8, 8, None), (4, 0, 8, b""), (5, 8, 8, b"x" * 64)]
    blocks = I.blocks_of(spark.createDataFrame(images, "image_id int, width int, height int, content binary"), "gray").collect()
    assert [(r["image_id"], set(r["s"])) for r in blocks] == [(5, {ord("x") - 128})]


def test_sides_up_to_65535(spark):
    rows = [(1, 65535, 2, b"\0"), (2, 65536, 2, b"\0"), (3, 2, 65536, b"\0")]
    files = containers.baseline_files(spark.createDataFrame(rows, "image_id int, width int, height int, scan binary"), Q.matrices(75), "400")
    out = {r["image_id"]: (r["width"], r["height"], r["jpeg"] is None) for r in containers.inspected(files).collect()}
    assert out == {1: (65535, 2, False), 2: (None, None, True), 3: (None, None, True)}


def test_headers_behind_many_segments(spark):
    jpeg = bytes(containers.gray_files(Q.coded(spark, SF), Q.matrices(75)).first()["jpeg"])
    rows = [(n, jpeg[:20] + b"\xff\xe5\x00\x04ab" * n + jpeg[20:]) for n in (0, 63, 64, 70, 255, 5000)]
    out = containers.inspected(spark.createDataFrame(rows, "image_id int, jpeg binary")).collect()
    assert len({(r["width"], r["height"], tuple(r["luma"])) for r in out}) == 1 and out[0]["luma"] == Q.matrices(75)[0] and out[0]["dqt"] == 1
    assert containers.segments(spark.createDataFrame(rows[-1:], "image_id int, jpeg binary")).count() > 5000


def test_matrices_of_8_and_16_bits_and_broken_ones(spark):
    def file(*tables):
        body = b"".join(tables)
        return b"\xff\xd8\xff\xdb" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\x00\x02"

    small, wide, zero = b"\x00" + bytes(range(1, 65)), b"\x11" + b"".join((k * 10).to_bytes(2, "big") for k in range(64)), b"\x02" + bytes(64)
    cases = [file(small, wide), file(small, zero), file(small[:-1]), file(b"\x20" + bytes(64)), file(b"\x04" + bytes(64)), b"", None, b"\xff\xd8"]
    out = {r["image_id"]: r for r in containers.inspected(spark.createDataFrame(list(enumerate(cases)), "image_id int, jpeg binary")).collect()}
    assert [out[k]["dqt"] for k in range(8)] == [2, 2, 0, 0, 0, 0, 0, 0]
    assert [out[0]["luma"][p] for p in zigzag_order()] == list(range(1, 65))
    assert [out[0]["chroma"][p] for p in zigzag_order()] == [max(1, min(255, k * 10)) for k in range(64)] and out[1]["chroma"] is None


def profile_files(spark, bodies: dict, most: int) -> dict:
    rows = spark.createDataFrame(list(bodies.items()), "image_id int, iccp binary")
    return {r["image_id"]: None if r["t"] is None else b"\xff\xd8" + bytes.fromhex(r["t"]) + b"\xff\xd9" for r in rows.select("image_id", containers.profile_text(F.col("iccp"), most).alias("t")).collect()}


def test_profiles_of_255_parts_and_no_more(spark):
    bodies = {1: bytes(range(255)) * 10, 2: bytes(range(256)) * 10, 3: b"", 4: None}
    files = profile_files(spark, bodies, 10)
    assert files[2] is None and containers.profile_in(containers.walked(files[1])) == bodies[1]
    assert containers.profile_in(containers.walked(files[3])) is None


def test_images_of_one_row_visit_nothing(spark):
    out = C.riskiness(spark.createDataFrame([(0, 0, x, 255, 0, 0) for x in range(9)], "image_id int, y int, x int, r int, g int, b int")).first()
    assert (out["visited"], out["risk"], out["mode"]) == (0, 0.0, "420")


def test_numbers_that_do_not_fit_are_null(spark):
    out = spark.range(1).select(containers.be(F.lit(65535), 2).alias("a"), containers.be(F.lit(65536), 2).alias("b"), containers.be(F.lit(8), 2).alias("c")).first()
    assert tuple(out) == ("FFFF", None, "0008")


def test_headers_of_truncated_files_are_never_wrong(spark):
    jpeg = bytes(containers.gray_files(Q.coded(spark, SF), Q.matrices(75)).first()["jpeg"])
    cut = [(n, jpeg[:n]) for n in range(0, 700, 7)] + [(9999, jpeg)]
    out = {r["image_id"]: r for r in containers.inspected(spark.createDataFrame(cut, "image_id int, jpeg binary")).collect()}
    whole = (out[9999]["width"], out[9999]["height"], out[9999]["components"])
    assert whole[0] == 8 and whole[2] == 1
    assert {(r["width"], r["height"], r["components"]) for r in out.values()} <= {whole, (None, None, None)}


def test_kinds(spark):
    rows = [(b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n",), (b"P6\n",), (b"",), (b"GIF8",)]
    out = [r[0] for r in spark.createDataFrame(rows, "c binary").select(containers.kind(F.col("c"))).collect()]
    assert out == ["JPG", "PNG", "PPM", "???", "???"]


def test_profiles_are_cut_and_put_together(spark):
    body = bytes(range(256)) * 10
    jpeg = profile_files(spark, {1: body}, 1000)[1]
    parts = containers.walked(jpeg)
    assert len(parts) == 3 and containers.profile_in(parts[::-1]) == body
    assert containers.profile_in(parts[:2]) is None and containers.profile_in([*parts, parts[0]]) is None


def test_gray_images_are_recognised(spark):
    rows = [(0, y, x, 128, 128, 128) for y in range(16) for x in range(16)]
    out = C.riskiness(spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")).first()
    assert out["mode"] == "400" and out["risk"] == 0


def test_the_rest_works_without_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)
