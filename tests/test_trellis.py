"""Searched levels against every choice of short blocks, and against a plain search of long ones."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.tables import BASE_QUANT, zigzag_order
from tessera.operators import coding as C
from tessera.operators import trellis as T

LENGTHS = T.ac_lengths()


def quantised(a: int, q: int) -> int:
    reciprocal, share = (65535 if q == 1 else (65536 + q // 2) // q), (128 if q == 1 else 120)
    return ((a + ((share * q * 16 + 128) >> 8)) * reciprocal >> 16) >> 4


def cost(v: list[int], q: list[int], levels: list[int]) -> int:
    """Errors and weighted bits of levels in zigzag order (the first left out), without the end of the block."""
    order, total, last = zigzag_order(), 0, 0
    for i in range(1, 64):
        a, step, n = abs(v[order[i]]), q[order[i]], abs(levels[i])
        total += (a - n * step * 16) ** 2
        if n:
            run = i - 1 - last
            bits = n.bit_length() + (run >> 4) * LENGTHS[0xF0] + LENGTHS[(run & 15) << 4 | n.bit_length()]
            total, last = total + step * step * 256 // 32 * bits, i
    return total


def options(v: list[int], q: list[int]) -> list[list[int]]:
    out = []
    for p in zigzag_order()[1:]:
        n = quantised(abs(v[p]), q[p])
        less = (1 << max(0, n.bit_length() - 1)) - 1
        out.append(sorted({0, n, less}))
    return out


@pytest.mark.parametrize("quality", [20, 75, 95])
def test_searched_levels_cost_least(spark, quality):
    rng, scale = random.Random(quality), 5000 // quality if quality < 50 else 2 * (100 - quality)
    q = [max(1, min(255, (m * scale + 50) // 100)) for m in BASE_QUANT[0]]
    blocks = []
    for k in range(40):
        v = [0] * 64
        for p in rng.sample(range(1, 64), 7):
            v[p] = rng.choice([-1, 1]) * rng.randrange(0, 60 * q[p])
        v[0] = rng.randrange(-9000, 9000)
        blocks.append((k, v))
    blocks += [(90, [0] * 64), (91, [16000] * 64), (92, [-500] + [rng.randrange(-900, 900) for _ in range(63)])]
    df = spark.createDataFrame(blocks, "k int, v array<int>")
    out = {r["k"]: r["levels"] for r in T.levels(df, C.steps_at(F.lit(quality), F.lit(0))).collect()}
    for k, v in blocks[:40]:
        some = options(v, q)
        assert all(abs(n) in some[i] and n * v[zigzag_order()[i + 1]] >= 0 for i, n in enumerate(out[k][1:]))
        best = min(cost(v, q, [0, *x]) for x in itertools.product(*some))
        assert cost(v, q, out[k]) == best
        assert abs(out[k][0]) == ((abs(v[0]) + ((128 * q[0] * 16 + 128) >> 8)) * (65535 if q[0] == 1 else (65536 + q[0] // 2) // q[0]) >> 16) >> 4
    assert out[90] == [0] * 64
    for k in (91, 92):
        v = dict(blocks)[k]
        plain = [0] + [(-1 if v[p] < 0 else 1) * quantised(abs(v[p]), q[p]) for p in zigzag_order()[1:]]
        assert cost(v, q, out[k]) <= cost(v, q, plain)


def node_by_node(v: list[int], q: list[int]) -> list[int]:
    """Levels of the same search, one node after the other; of equal scores the latest node wins, and the second choice."""
    order, lost, nodes = zigzag_order(), [0] * 64, [(0, 0, 0, -1)]  # (place, score, level, node before)
    for i in range(1, 64):
        a, step = abs(v[order[i]]), q[order[i]]
        lost[i] = lost[i - 1] + a * a
        n, best = quantised(a, step), None
        for level in [n, (1 << max(0, n.bit_length() - 1)) - 1][: min(2, n.bit_length())]:
            for k in range(len(nodes) - 1, -1, -1):
                run = i - 1 - nodes[k][0]
                bits = level.bit_length() + (run >> 4) * LENGTHS[0xF0] + LENGTHS[(run & 15) << 4 | level.bit_length()]
                score = nodes[k][1] + lost[i - 1] - lost[nodes[k][0]] + step * step * 8 * bits
                if k == len(nodes) - 1 or score < least[0]:
                    least = (score, k)
            score = least[0] + (a - level * step * 16) ** 2
            if best is None or score <= best[1]:
                best = (i, score, -level if v[order[i]] < 0 else level, least[1])
        nodes += [best] if best else []
    k = min(range(len(nodes)), key=lambda k: (nodes[k][1] - lost[nodes[k][0]], -k))
    out = [0] * 64
    while k > 0:
        out[nodes[k][0]], k = nodes[k][2], nodes[k][3]
    return out[1:]


def test_ties_and_rows_without_blocks(spark):
    rng, blocks = random.Random(3), {}
    for k in range(1500):  # more than a slice; multiples of a few steps, so that many scores are equal
        unit = rng.choice([1, 16, 40, 128])
        blocks[k] = [rng.choice([-1, 1]) * rng.randrange(0, 12) * unit if rng.random() < 0.6 else 0 for _ in range(64)]
    rows = [(k, v, [8 if k % 2 else 1 + k % 60] * 64) for k, v in blocks.items()]
    rows += [(-1, None, [8] * 64), (-2, [None] + [300] * 63, [8] * 64), (-3, [300] * 64, None)]
    df = spark.createDataFrame(rows, "k int, v array<int>, q array<int>").repartition(2)
    some = T.levels(df, F.col("q"))
    assert some.columns == ["k", "v", "q", "levels"]
    out = {r["k"]: r["levels"] for r in some.collect()}
    assert len(out) == len(rows)
    assert [k for k, v, q in rows if k >= 0 and out[k][1:] != node_by_node(v, q)] == []
    assert all(out[k] == [None] + [0] * 63 for k in (-1, -2, -3))
    with pytest.raises(Exception, match="a block has 64"):
        T.levels(spark.createDataFrame([(1, [5] * 10)], "k int, v array<int>"), C.steps_at(F.lit(75), F.lit(0))).collect()


def test_many_dense_blocks_take_little_time(spark):
    """20,000 blocks without a zero coefficient."""
    blocks = spark.range(0, 20000, 1, 8).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.pmod(F.hash("id", p), F.lit(4000)) + 300).cast("int")))
    out = T.levels(blocks, C.steps_at(F.lit(75), F.lit(0)))
    summed = lambda df: df.select(F.size("levels").alias("n"), F.exists("levels", lambda x: x != 0).alias("some")).groupBy("n", "some").count().collect()
    summed(T.levels(blocks.where("id < 8"), C.steps_at(F.lit(75), F.lit(0))))
    began = time.time()
    assert [(r["n"], r["some"], r["count"]) for r in summed(out)] == [(64, True, 20000)]
    assert time.time() - began < 12
