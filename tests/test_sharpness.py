"""Fitted sharpness, tiles with halos, and modes by image, against plain loops."""

import random

from pyspark.sql import functions as F

from tessera.operators import coding as C
from tessera.operators import images as I
from tessera.operators import sharpness as S

SHAPE = "image_id int, width int, height int, content binary"


def bucket(y, u, v):
    level = lambda x: ((max(-128, min(127, x)) + 128) * 1542) >> 16
    return level(y) + 7 * level(u) + 49 * level(v)


def yuv(r, g, b, shift=16):
    half = 1 << (shift - 1)
    return (19595 * r + 38469 * g + 7471 * b + 32768 - 8388608) >> 16, (-11059 * r - 21709 * g + 32768 * b + half) >> shift, (32768 * r - 27439 * g - 5329 * b + half) >> shift


def plain_triples(raw: bytes, width: int, height: int) -> dict:
    px = [[tuple(raw[3 * (y * width + x) : 3 * (y * width + x) + 3]) for x in range(width)] for y in range(height)]
    out: dict = {}
    for y in range(height - 1):
        for x in range(width - 1):
            i, e, s = (bucket(*yuv(*p)) for p in (px[y][x], px[y][x + 1], px[y + 1][x]))
            cell = [px[min(y // 2 * 2 + j, height - 1)][min(x // 2 * 2 + k, width - 1)] for j in (0, 1) for k in (0, 1)]
            _, hu, hv = yuv(*(sum(c) for c in zip(*cell, strict=True)), 18)
            _, u, v = yuv(*px[y][x])
            n, loss = out.get((i, e, s), (0, 0))
            out[i, e, s] = (n + 1, loss + abs(u - hu) + abs(v - hv))
    return out


def images(spark):
    rng = random.Random(2)
    rows = []
    for k, (w, h) in enumerate([(9, 7), (8, 8), (1, 20), (20, 1), (33, 18)]):
        rows.append((k, w, h, bytes(rng.choice([0, 90, 128, 140, 255]) for _ in range(3 * w * h))))
    return rows, spark.createDataFrame([*rows, (90, 4, 4, b"short"), (91, None, 4, b""), (92, 4, 4, None)], SHAPE)


def test_triples_equal_loops_whatever_the_bands(spark, monkeypatch):
    rows, df = images(spark)
    want = {(k, *t): v for k, w, h, raw in rows for t, v in plain_triples(raw, w, h).items()}
    assert {(r["image_id"], r["i"], r["e"], r["s"]): (r["n"], r["loss"]) for r in S.triples_of(df).collect()} == want
    for band in (1, 70):
        monkeypatch.setattr(I, "BAND", band)
        got = {(r["image_id"], r["i"], r["e"], r["s"]): (r["n"], r["loss"]) for r in S.triples_of(df.repartition(3)).collect()}
        assert got == want


def test_tables_hold_mean_losses_and_scores_add_up(spark):
    rows, df = images(spark)
    triples = S.triples_of(df)
    sums: dict = {}
    for k, w, h, raw in rows:
        for (i, e, s), (n, loss) in plain_triples(raw, w, h).items():
            for pair in ((i, e), (i, s)):
                a, b = sums.get(pair, (0, 0))
                sums[pair] = (a + n, b + loss)
    table = {k: min(255, loss // n) for k, (n, loss) in sums.items()}
    fitted = S.fitted(triples)
    assert {(r["a"], r["b"]): r["score"] for r in fitted.collect()} == table
    out = {r["image_id"]: r for r in S.recommended(df.where("length(content) > 10"), fitted).collect()}
    for k, w, h, raw in rows:
        scores = [(table.get((i, e), 0) + table.get((i, s), 0) + table.get((e, s), 0), n) for (i, e, s), (n, _) in plain_triples(raw, w, h).items()]
        loud, total = sum(n for x, n in scores if x > 4), sum(n * x for x, n in scores if x > 4)
        risk = 0.0 if not loud or loud * 100 < w * h else min(100.0, total / loud * 4)
        assert (out[k]["scored"], out[k]["total"], out[k]["risk"]) == (loud, total, risk)
    assert out[2]["mode"] == out[3]["mode"] == "420"


def test_tiles_give_every_pixel_its_neighbours(spark):
    rows = [(k, y, x, 1000 * k + 40 * y + x) for k, (w, h) in enumerate([(13, 9), (1, 5), (8, 8)]) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, i int")
    value = {(k, y, x): i for k, y, x, i in rows}
    for side in (2, 4, 64):
        got = {(r["image_id"], r["y"], r["x"]): (r["i"], r["e"], r["s"]) for r in S.tiled(df, side).collect()}
        assert got == {(k, y, x): (i, value.get((k, y, x + 1)), value.get((k, y + 1, x))) for (k, y, x), i in value.items()}


def test_modes_route_each_image_by_itself(spark):
    gray = bytes([100] * 3 * 256)
    red = bytes(x for y in range(16) for k in range(16) for x in ((255, 0, 0) if (k + y) % 2 else (0, 255, 255)))
    df = spark.createDataFrame([(1, 16, 16, gray), (2, 16, 16, red)], SHAPE)
    chosen = df.join(S.recommended(df, S.fitted(S.triples_of(df))).select("image_id", "mode"), "image_id")
    blocks = I.blocks_of(chosen, "rgb", F.col("mode")).groupBy("image_id", "mode").count().collect()
    assert {(r["image_id"], r["mode"], r["count"]) for r in blocks} == {(1, "400", 4), (2, "444", 12)}


def test_riskiness_of_pixels_and_of_bytes_agree(spark):
    rows, df = images(spark)
    px = [(k, j // w, j % w, *raw[3 * j : 3 * j + 3]) for k, w, h, raw in rows for j in range(w * h)]
    a = {r["image_id"]: (r["visited"], r["scored"], r["total"], r["risk"]) for r in C.riskiness(spark.createDataFrame(px, "image_id int, y int, x int, r int, g int, b int")).collect()}
    every = spark.range(343).selectExpr("CAST(id AS int) a").crossJoin(spark.range(343).selectExpr("CAST(id AS int) b"))
    table = every.withColumn("score", C.synthetic_sharpness(F.col("a"), F.col("b")))
    b = {r["image_id"]: (r["visited"], r["scored"], r["total"], r["risk"]) for r in S.recommended(df.where("length(content) > 10"), table).collect()}
    assert a == b
