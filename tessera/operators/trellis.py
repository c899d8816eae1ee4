"""Levels by rate and distortion: a dynamic programme over the places of many blocks at once.

Each coefficient that doesn't quantise to zero may take its level or the largest level of one bit
less, or be dropped. A node is such a choice; its score is the least of those of the nodes before
it, plus the errors of what is dropped between them and its own, plus its bits (run, level and
escapes of long runs, by given code lengths) times a sixteenth-squared step over 32. Blocks come
in Arrow batches; a step along the zigzag order compares all nodes before it in all blocks of a
slice, in integers, so a block costs 63 short steps and no shuffle takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from tessera.functions.tables import standard_codes, zigzag_order
from tessera.operators import images as I

#: Blocks searched together: their nodes stay in a core's cache.
SLICE = 512
#: The score of a place that has no node.
NONE = 1 << 62


def ac_lengths(qidx: int = 0) -> list[int]:
    """Bits of the standard AC code of each symbol, 0 where there is none."""
    out = [0] * 256
    for cls, q, sym, n, _ in standard_codes():
        if (cls, q) == ("ac", qidx):
            out[sym] = n
    return out


def coded_bits(lengths: list[int]) -> np.ndarray:
    """(63, 16): bits of a level of 0 to 15 bits behind a run of 0 to 62 zeros."""
    run = np.arange(63)
    return np.arange(16) + (run >> 4)[:, None] * lengths[0xF0] + np.array(lengths).reshape(16, 16)[run & 15]


def searched(v: np.ndarray, steps: np.ndarray, lengths: list[int], bias: int = 120) -> np.ndarray:
    """Levels in zigzag order of coefficients (x16) under steps, both (n, 64) in natural order.

    What follows depends on a node's place and score only, so of the choices at a place just the
    better one becomes a node. Of equal scores the latest node wins, and the second choice. Nodes
    are held by place from the last (row 0) to the block's start (row 63): the row of a node before,
    counted from the first one that may be, is the run between them.
    """
    order, coded, every = np.array(zigzag_order()), coded_bits(lengths), np.arange(len(v))
    plain, size, step = (x[:, order].T for x in (I.quantised(v, steps, bias), np.abs(v), steps))
    weight, full = step * step * 8, np.abs(plain)  # 8: sixteen squared over 32
    bits = I.bit_length(full)
    less = (1 << np.maximum(bits - 1, 0)) - 1
    lost = np.cumsum(np.where(np.arange(64)[:, None] > 0, size * size, 0), axis=0)
    # base: the score less what was dropped up to the place
    base, came, level = np.full((64, len(v)), NONE), np.zeros((64, len(v)), np.int64), np.zeros((64, len(v)), np.int64)
    base[63] = 0
    for i in range(1, 64):

        def best(n: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            scores = base[64 - i :] + weight[i] * coded[:i].take(np.maximum(wide, 0), axis=1)
            run = scores.argmin(axis=0)
            return np.where(wide > 0, scores[run, every] + (size[i] - n * step[i] * 16) ** 2, NONE), run

        (first, run), (second, other) = best(full[i], bits[i]), best(less[i], bits[i] - 1)
        base[63 - i] = np.where(bits[i] > 0, np.minimum(first, second) + lost[i - 1] - lost[i], NONE)
        came[i], level[i] = i - 1 - np.where(second <= first, other, run), np.where(second <= first, less[i], full[i])
    # a path ends where the base is least, as all that follows is dropped
    out, at = np.zeros((len(v), 64), np.int64), 63 - base.argmin(axis=0)
    out[:, 0] = plain[0]
    for i in range(63, 0, -1):
        on = at == i
        out[:, i] = np.where(on, np.where(plain[i] < 0, -level[i], level[i]), 0)
        at = np.where(on, came[i], at)
    return out


def levels(blocks: DataFrame, steps: Column, qidx: int = 0, bias: int = 120) -> DataFrame:
    """blocks (…, v: coefficients x16) with levels, in zigzag order: the first quantised as ever, the others searched.

    If coefficients or steps are null, or hold a null, the first level is null and the others are 0.
    """
    keep, lengths = [c for c in blocks.columns if c != "levels"], ac_lengths(qidx)

    def run(batches):
        for batch in batches:
            if any(pc.any(pc.not_equal(pc.list_value_length(c), 64)).as_py() for c in batch.columns[:2]):
                raise ValueError("a block has 64 coefficients and 64 steps")
            for low in range(0, batch.num_rows, SLICE):
                some = batch.slice(low, SLICE)
                (has_v, v), (has_steps, q) = I.samples_of(some.column(0)), I.samples_of(some.column(1))
                at, mine, own = np.intersect1d(has_v, has_steps, assume_unique=True, return_indices=True)
                out, unknown = np.zeros((some.num_rows, 64), np.int32), np.zeros((some.num_rows, 64), bool)
                out[at], unknown[:, 0] = searched(v[mine], q[own], lengths, bias), True
                unknown[at, 0] = False
                flat = pa.array(out.ravel(), mask=unknown.ravel())
                made = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * 64, flat)
                yield pa.RecordBatch.from_arrays([*some.columns[2:], made], names=[*keep, "levels"])

    kinds = dict(blocks.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "levels array<int>"])
    return blocks.select("v", steps.alias("steps"), *keep).mapInArrow(run, schema)
