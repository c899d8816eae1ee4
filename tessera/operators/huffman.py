"""Code tables fitted to symbol counts, with lengths of 16 at most and no code of all ones.

Lengths come from the package-merge method, which is optimal under the limit; a symbol of
no weight takes the all-ones code and is dropped. Codes are canonical: in order of length,
then symbol. A group is the counts of one table, so it holds 256 rows at most whatever the
size of the image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ["image_id", "qidx", "cls"]
RESERVED = 256
#: Tables looked at together, and symbols of those that are fitted together, about.
TABLES, SYMBOLS = 1 << 13, 1 << 16


def merged_lengths(weights: np.ndarray, most: int = 16) -> np.ndarray:
    """Lengths of codes for many tables of as many symbols: weights (tables, symbols), ascending in each; 2 to 2^most symbols.

    Each level merges the leaves with the pairs of the level below, leaves first among equals. What
    the shortest code needs are the first places of the top level, and so of each one below: of its
    leaves the first ones, of its pairs twice as many places further down.
    """
    n = weights.shape[1]
    level, leaves = weights, []
    for _ in range(most - 1):
        half = level.shape[1] // 2 * 2
        both = np.concatenate([weights, level[:, 0:half:2] + level[:, 1:half:2]], axis=1)
        order = np.argsort(both, axis=1, kind="stable")
        level = np.take_along_axis(both, order, axis=1)
        leaves.append(np.concatenate([np.zeros((len(weights), 1), np.int32), np.cumsum(order < n, axis=1, dtype=np.int32)], axis=1))
    lengths, row, place = np.zeros(weights.shape, np.int64), np.arange(len(weights)), np.arange(n)
    needed = np.full(len(weights), min(2 * n - 2, level.shape[1]))
    for seen in reversed(leaves):
        own = seen[row, needed]
        lengths += place < own[:, None]
        needed = 2 * (needed - own)
    return lengths + (place < needed[:, None])


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Symbol -> length, for at least two symbols and at most 2^most."""
    leaves = sorted((n, symbol) for symbol, n in counts.items())
    lengths = merged_lengths(np.array([[n for n, _ in leaves]], np.int64), most)[0].tolist()
    return dict(zip((symbol for _, symbol in leaves), lengths, strict=True))


def tables_of(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths and codes (tables, symbols) of many tables of as many symbols each, in order of length, then symbol."""
    free = np.full((len(symbols), 1), RESERVED)
    symbols, weights = np.concatenate([free, symbols], axis=1), np.concatenate([free * 0, weights], axis=1)
    order = np.lexsort((symbols, weights))
    symbols, lengths = np.take_along_axis(symbols, order, axis=1), merged_lengths(np.take_along_axis(weights, order, axis=1))
    order = np.argsort(lengths * 512 + symbols, axis=1)
    symbols, lengths = np.take_along_axis(symbols, order, axis=1), np.take_along_axis(lengths, order, axis=1)
    share = 1 << (16 - lengths)
    codes = (np.cumsum(share, axis=1) - share) >> (16 - lengths)
    kept = symbols != RESERVED
    return tuple(x[kept].reshape(len(x), -1) for x in (symbols, lengths, codes))


def canonical_codes(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code) for counts of at least one symbol."""
    each = tables_of(np.array([list(counts)], np.int64), np.array([list(counts.values())], np.int64))
    return list(zip(*(x[0].tolist() for x in each), strict=True))


def fitted_codes(counts: DataFrame) -> DataFrame:
    """(image_id, qidx, cls, sym, len, code) for symbol counts (image_id, qidx, cls, sym, n); counts of zero take no code."""
    kinds = dict(counts.dtypes)
    # one row a table: 256 symbols at most
    tables = counts.where("n > 0").groupBy(*BY).agg(F.collect_list(F.struct(F.col("sym").cast("int").alias("sym"), F.col("n").cast("long").alias("n"))).alias("t"))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TABLES):
                batch = whole.slice(start, TABLES)
                sizes, (symbol, n) = np.diff(batch.column(3).offsets.to_numpy()), (x.to_numpy() for x in batch.column(3).flatten().flatten())
                first = np.cumsum(sizes) - sizes
                for size in np.unique(sizes):  # tables of one size are fitted together
                    alike = np.flatnonzero(sizes == size)
                    for low in range(0, len(alike), SYMBOLS // size):
                        own = alike[low : low + SYMBOLS // size]
                        at = first[own][:, None] + np.arange(size)
                        each = tables_of(symbol[at].astype(np.int64), n[at])
                        rows = pa.array(np.repeat(own, size))
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), *(pa.array(x.ravel().astype(np.int32)) for x in each)], names=[*BY, "sym", "len", "code"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in BY) + ", sym int, len int, code int"
    return tables.select(*BY, "t").mapInArrow(run, schema)


def fitted_size(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """(image_id, bits) of scans coded with tables of their own (without stuffing), and table_bytes, what the tables' segments take."""
    suffix = F.when(F.col("cls") == "dc", F.col("sym")).otherwise(F.col("sym") % 16)
    tables = counts.join(codes, [*BY, "sym"], "right").groupBy(*BY).agg(F.sum(F.col("n") * (F.col("len") + suffix)).alias("b"), (F.count("*") + 21).alias("t"))
    return tables.groupBy("image_id").agg(F.sum("b").cast("long").alias("bits"), F.sum("t").cast("long").alias("table_bytes")).where("bits IS NOT NULL")
