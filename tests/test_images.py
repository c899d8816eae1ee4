"""Work on many small images, tables and slices at once, against one at a time."""

import numpy as np
import pyarrow as pa
import pytest

from tessera import queries as Q
from tessera.operators import huffman as H
from tessera.operators import images as I


def image_rows(kind: str, mode: str, n: int) -> tuple[pa.RecordBatch, list]:
    rng = np.random.default_rng(5)
    sides = [(int(w), 2 * int(h)) for w, h in zip(rng.choice([7, 38], n), rng.integers(0, 30, n), strict=True)]
    raws = [rng.integers(0, 256, I.bytes_of(kind, I.PLANAR.get(kind, mode), w, h) + 3).astype(np.uint8).tobytes() for w, h in sides]
    rows = [(k, w, h, raw, kind, mode) for k, ((w, h), raw) in enumerate(zip(sides, raws, strict=True))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image_id", "width", "height", "content", "kind", "mode"]), rows


@pytest.mark.parametrize("kind,mode", Q.SAMPLED)
def test_small_images_are_worked_on_together(kind, mode, monkeypatch):
    """300 images of two widths took 300 rounds of array calls."""
    batch, rows = image_rows(kind, mode, 300)
    want = {r[0]: np.concatenate([x.reshape(-1, 64) for _, _, x in I.bands(r[3], kind, mode, r[1], r[2])] or [np.zeros((0, 64), int)]) for r in rows}
    calls, whole = [], I.in_units
    monkeypatch.setattr(I, "in_units", lambda *a: calls.append(1) or whole(*a))
    out = pa.Table.from_batches(I.laying(["v", "before"], I.coefficients_listed)([batch])).to_pylist()
    assert len(calls) <= 8
    got: dict = {}
    for r in out:
        got.setdefault(r["image_id"], []).append(r)
    assert set(got) == {k for k, x in want.items() if len(x)}
    for k, mine in got.items():
        v = I.transform(want[k])
        assert [r["scan_idx"] for r in mine] == list(range(len(v))) and np.array_equal([r["v"] for r in mine], v)
        last: dict = {}
        for r in mine:
            assert r["before"] == last.get(r["comp"], 0)
            last[r["comp"]] = r["v"][0]


def test_bands_of_large_images_go_on_from_each_other(monkeypatch):
    batch, _ = image_rows("rgb", "420", 20)
    plain = pa.Table.from_batches(I.laying(["v", "before"], I.coefficients_listed)([batch])).sort_by([("image_id", "ascending"), ("scan_idx", "ascending")])
    monkeypatch.setattr(I, "BAND", 1)
    cut = pa.Table.from_batches(I.laying(["v", "before"], I.coefficients_listed)([batch])).sort_by([("image_id", "ascending"), ("scan_idx", "ascending")])
    assert plain.equals(cut)


def package_merge(counts: dict, most: int) -> dict:
    leaves = sorted((n, symbol, (symbol,)) for symbol, n in counts.items())
    level = leaves
    for _ in range(most - 1):
        level = sorted(leaves + [(a[0] + b[0], -1, a[2] + b[2]) for a, b in zip(level[::2], level[1::2], strict=False)], key=lambda x: x[0])
    lengths = dict.fromkeys(counts, 0)
    for _, _, symbols in level[: 2 * len(counts) - 2]:
        for symbol in symbols:
            lengths[symbol] += 1
    return lengths


def test_tables_of_one_size_are_fitted_together():
    """each table was a pandas group of its own."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 60, 256):
        symbols = np.stack([rng.choice(256, size, replace=False) for _ in range(40)])
        weights = np.where(rng.random((40, 1)) < 0.5, rng.integers(1, 5, (40, size)), np.floor(np.exp(rng.uniform(0, 25, (40, size)))).astype(np.int64))
        for mine, n, s, length, code in zip(symbols, weights, *H.tables_of(symbols, weights), strict=True):
            want = package_merge(dict(zip(mine.tolist(), n.tolist(), strict=True)) | {H.RESERVED: 0}, 16)
            assert dict(zip(s.tolist(), length.tolist(), strict=True)) == {k: v for k, v in want.items() if k != H.RESERVED}
            assert list(zip(length, s, strict=True)) == sorted(zip(length, s, strict=True))
            words = [format(c, f"0{n}b") for n, c in zip(length.tolist(), code.tolist(), strict=True)]
            assert all(not b.startswith(a) for a in words for b in words if a != b) and len(set(words)) == size


def test_tables_do_not_mix(spark):
    rows = [(k, q, c, s, 1 + (k * 7 + s * s) % 50) for k in range(30) for q in (0, 1) for c in ("dc", "ac") for s in range(1 + (k + q) % 9)] + [(99, 0, "dc", 1, 0)]
    out: dict = {}
    for r in H.fitted_codes(spark.createDataFrame(rows, "image_id int, qidx int, cls string, sym int, n long").repartition(3)).collect():
        out.setdefault((r["image_id"], r["qidx"], r["cls"]), []).append((r["sym"], r["len"], r["code"]))
    groups: dict = {}
    for k, q, c, s, n in rows[:-1]:
        groups.setdefault((k, q, c), {})[s] = n
    assert out == {k: H.canonical_codes(v) for k, v in groups.items()}


@pytest.mark.parametrize("mode", ["400", "420", "444"])
def test_slices_of_images_are_those_of_their_blocks(spark, mode):
    """blocks were shuffled and coded twice, and each slice packed by itself."""
    from tessera.operators import packing

    batch, _ = image_rows("rgb", mode, 40)
    images = spark.createDataFrame(pa.Table.from_batches([batch]).to_pylist(), "image_id long, width int, height int, content binary, kind string, mode string").select("image_id", "width", "height", "content").coalesce(2)
    blocks = I.coded(I.blocks_of(images, "rgb", mode), Q.matrices(80))
    read = lambda df: {(r["image_id"], r["slice"]): (r["n_bits"], r["head"], bytes(r["data"])) for r in df.collect()}
    direct = packing.slices_of_images(images, "rgb", mode, Q.matrices(80), size=18)
    assert read(direct) == read(packing.packed_slices(blocks, size=18))
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()


def test_slices_of_large_images_meet(monkeypatch):
    from tessera.functions.tables import standard_codes
    from tessera.operators import packing

    batch, _ = image_rows("rgb", "420", 20)
    monkeypatch.setattr(I, "BATCH", 6)
    found = []
    for band in (1 << 18, 1):
        monkeypatch.setattr(I, "BAND", band)
        code = I.coding_images(_Columns(), Q.matrices(80))
        tables = packing.code_tables(standard_codes())
        out = packing.by_slices(packing.leveling(18)(code([batch])), lambda rows, starts: packing.packed(rows, starts, rows.column("diff").to_numpy(), tables))
        found.append(pa.Table.from_batches(out).sort_by([("image_id", "ascending"), ("slice", "ascending")]).to_pylist())
    assert found[0] == found[1] and len({r["image_id"] for r in found[0]}) > 10


class _Columns:
    columns = ("image_id", "width", "height", "content")


def test_searches_within_tasks_find_what_those_over_tables_find(spark):
    """Coefficients were stored, counted by value and joined again in each pass."""
    from pyspark.sql import functions as F

    from tessera.operators import search
    from tessera.sources import containers

    batch, _ = image_rows("rgb", "420", 24)
    rows = pa.Table.from_batches([batch]).to_pylist()
    images = spark.createDataFrame(rows, "image_id long, width int, height int, content binary, kind string, mode string").drop("kind", "mode")
    some = F.when(F.col("image_id") % 7 != 0, 20 + F.col("image_id") % 20)
    head = containers.header_bytes(3, F.lit(2 * 174), *[F.lit(0)] * 4)
    for measure, target, evaluate in (("psnr", some, search.psnr_evaluator), ("size", some * F.octet_length("content") / 40 + 600, search.size_evaluator)):
        goals = images.select("*", target.alias("target"), F.lit(1).alias("tolerance"), (F.col("image_id") % 3 * 20).alias("low"), F.lit(90).alias("high"), F.lit(75).alias("start"), head.alias("more"))
        found = search.searched_images(goals, "rgb", "420", measure)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        read = lambda df: {r["image_id"]: (r["target"], r["q"], r["value"] and round(r["value"], 6), r["passes"]) for r in df.collect()}
        want = read(search.searched(goals.drop("width", "height", "content"), evaluate(I.coefficients_of(images, "rgb", "420"))))
        assert read(found) == want and len({x[3] for x in want.values()}) > 2


def test_sums_of_neighbours_are_those_of_triples(spark):
    """triples, up to a row a pixel, were shuffled, stored and joined three times."""
    from tessera.operators import sharpness as S

    batch, _ = image_rows("rgb", "444", 30)
    images = spark.createDataFrame(pa.Table.from_batches([batch]).to_pylist(), "image_id long, width int, height int, content binary, kind string, mode string").drop("kind", "mode").repartition(3)
    triples, parts = S.triples_of(images), S.pair_sums(images)
    table, own = S.fitted(triples).collect(), S.fitted_to(images)
    assert sorted(table) == sorted(own.collect()) and len(table) > 100
    assert sorted(S.judged_by(images, own).select("image_id", "visited", "scored", "total", "gray", "area", "risk", "mode").collect()) == sorted(S.recommended(images, own, triples).select("image_id", "visited", "scored", "total", "gray", "area", "risk", "mode").collect())
    assert parts.count() == len(table)


def test_neighbours_of_bands(monkeypatch):
    from tessera.operators import sharpness as S

    batch, _ = image_rows("rgb", "444", 12)
    read = lambda: sorted((int(n), a.tolist(), b.tolist(), c.tolist(), d.tolist()) for numbers, *x in S.neighbours(batch, "rgb") for n, a, b, c, d in zip(numbers, *x, strict=True))
    whole = read()
    monkeypatch.setattr(I, "BAND", 1)
    assert read() == whole and len(whole) > 50
