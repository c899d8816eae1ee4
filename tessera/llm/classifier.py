"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics come from one scan of the Arrow buffers (see `scanning`): length, word lengths, shares
of different words, word pairs and repeated neighbours, of capitals, digits, symbols, marks and
line ends. They are standardised over the training rows; cosines of random projections, from a
fixed seed, approximate a Gaussian kernel of width `WIDTH` on them. A training row is one whose
label is known and whose CRC-32 of the id isn't divisible by 5; the other remainders are four
folds. Each task sums its rows' normal equations by fold (a square matrix of fixed size, whatever
the rows), the sums are added up by matrix row, and the ridge solution of each three folds scores
the fourth. These scores, in BINS bins, are what the isotonic calibration (pool adjacent
violators, straight lines between the pools' centres) is fitted to, so it never sees a score of a
row that was learnt from; all four folds together give the final solution. All labelled rows
count; nothing is sampled.

Statistics, projections, cosines and solutions are held on grids whose sums doubles and 64-bit
integers hold exactly, so results depend on neither the order nor the number of partitions.

Null texts are empty, and an empty text has statistics of zeros and a score like others; a null
id is held out; rows that repeat an id are rows of their own, each learnt from if it has a label;
of several labels of an id the largest counts, null ones don't; without any training row every
score is 0.5, with one class only it is near that class; an empty table gives an empty result.
Only doc_id, text and the labels' doc_id and quality are read, so no column clashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.scanning import Scan, scans

FOURIER, WIDTH, RIDGE, SEED, BINS, CUT = 256, 4.0, 1e-3, 11, 2048, 0.3
#: Statistics are integers in this many parts of one; standardised ones, cosines and solutions have grids of their own.
UNIT, GRID, COSINE, SOLUTION = 1 << 16, 1 << 10, 1 << 14, 1 << 20
FAR = 6.0
LOW, HIGH = -0.5, 1.5
CLASSES = {
    "capitals": bytes(range(ord("A"), ord("Z") + 1)),
    "small": bytes(range(ord("a"), ord("z") + 1)),
    "digits": b"0123456789",
    "symbols": b"#$%&*|<>@^~{}[]\\/=+_",
    "loud": b"!?",
    "marks": b".,;:",
    "lines": b"\n",
}
NAMES = ("words", "chars", "length", "spread", "distinct", "top", "pairs", "again", "capitals", "digits", "symbols", "odd_ends", "loud", "marks", "lines", "other")


def statistics(s: Scan) -> np.ndarray:
    """NAMES of each row of a scan, in UNIT parts of one."""
    n, c = np.maximum(s.n_words, 1), s.counts
    chars = np.maximum(c["chars"], 1)
    by_row = lambda weights=None, which=slice(None): np.bincount(s.row[which], weights, s.n)
    length = np.minimum(s.lengths, 64)
    mean = by_row(length) / n
    hashes = s.hashes()
    order, new = s.groups(hashes)
    group = np.cumsum(new) - 1
    top = np.zeros(s.n)
    np.maximum.at(top, s.row[order[new]], np.bincount(group)) if len(order) else None
    same = np.zeros(len(order), np.uint64)  # a number for each different word of the row
    same[order] = group
    beside = np.flatnonzero(s.row[1:] == s.row[:-1])
    pairs = (same[beside] << np.uint64(32)) | same[beside + 1]
    row = s.row[beside]
    pair_order = np.argsort(pairs)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[pair_order][1:] != pairs[pair_order][:-1]
    several = np.maximum(s.n_words - 1, 1)
    last = s.data[s.end - 1] if len(s.end) else np.zeros(0, np.uint8)
    odd = np.isin(last, np.frombuffer(CLASSES["symbols"] + CLASSES["loud"], np.uint8))
    letters = np.maximum(c["capitals"] + c["small"], 1)
    out = np.stack([
        np.log1p(s.n_words), np.log1p(c["chars"]), mean, np.sqrt(np.maximum(by_row(length * length) / n - mean**2, 0)),
        by_row(which=order[new]) / n, top / n, np.bincount(row[pair_order[fresh]], minlength=s.n) / several, np.bincount(row[same[beside] == same[beside + 1]], minlength=s.n) / several,
        c["capitals"] / letters, c["digits"] / chars, c["symbols"] / chars, by_row(odd) / n,
        c["loud"] / n, c["marks"] / n, c["lines"] / n, (np.diff(s.offsets) - c["chars"]) / chars,
    ], axis=1)
    return np.rint(np.minimum(out, 1 << 10) * UNIT).astype(np.int64)


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fold, x) of all rows: fold is the CRC-32 of the id modulo 5, x the statistics."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
    rows = docs.select(F.col(text).alias("text"), F.col(id_col).alias("doc_id"), fold.cast("int").alias("fold"))

    def run(batches):
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(NAMES)), np.int64), *map(statistics, scans(batch.column(0), CLASSES))])
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=["doc_id", "fold", "x"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fold int, x array<long>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Features:
    """Cosines of random projections of standardised statistics, as integers in COSINE parts of one; the last is constant."""

    def __init__(self, mean: list[float], deviation: list[float], number: int = FOURIER, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = np.array(mean), np.array(deviation)
        self.weights = np.rint(rng.normal(0, 1 / width, (len(mean), number)) * GRID) / GRID
        self.phase = np.rint(rng.uniform(0, 2 * np.pi, number) * GRID) / GRID

    def __call__(self, x: np.ndarray) -> np.ndarray:
        standard = np.clip((x / UNIT - self.mean) / self.deviation, -FAR, FAR)
        angle = (np.rint(standard * GRID) / GRID) @ self.weights + self.phase
        return np.concatenate([np.rint(np.cos(angle) * COSINE), np.full((len(x), 1), float(COSINE))], axis=1)


def normal_equations(train: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Fold -> Z'Z with y as Z's last column, in COSINE^2 parts of one, of rows (fold, x, y)."""
    side = len(features.phase) + 2

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy()
            x, y = matrix(batch.column(1), len(NAMES)), batch.column(2).to_numpy()
            for low in range(0, len(y), 4096):
                some = slice(low, low + 4096)
                z = np.concatenate([features(x[some]), y[some, None] * float(COSINE)], axis=1)
                for f in np.unique(fold[some]):
                    own = z[fold[some] == f]
                    sums.setdefault(int(f), np.zeros((side, side), np.int64))
                    sums[int(f)] += (own.T @ own).astype(np.int64)
        yield from sent(sums)

    def sent(sums):
        for f, g in sums.items():
            rows = pa.ListArray.from_arrays(np.arange(side + 1, dtype=np.int32) * side, pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(side, f)), pa.array(np.arange(side)), rows], names=["fold", "i", "g"])

    def added(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for f, i, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2), side), strict=True):
                sums[f, i] = sums[f, i] + g if (f, i) in sums else g.copy()
        if sums:
            keys = np.array(list(sums))
            rows = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * side, pa.array(np.concatenate(list(sums.values()))))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), rows], names=["fold", "i", "g"])

    shape = "fold long, i long, g array<long>"
    parts = train.select("fold", "x", "y").mapInArrow(run, shape)
    out: dict[int, np.ndarray] = {}
    for f, i, g in parts.repartition("fold", "i").mapInArrow(added, shape).collect():  # 4 matrices of a fixed side
        out.setdefault(f, np.zeros((side, side), np.int64))[i] = g
    return out


def solved(g: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights of features in COSINE parts, the constant's unpenalised, on the grid of solutions."""
    both = g / float(COSINE) ** 2
    a, b = both[:-1, :-1], both[:-1, -1]
    rows = max(both[-2, -2], 1.0)
    penalty = np.full(len(a), ridge * rows)
    penalty[-1] = 1e-9
    return np.rint(np.linalg.solve(a + np.diag(penalty), b) * SOLUTION) / SOLUTION


def binned(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Ridge scores in bins: whole numbers and fractions from 0 to BINS."""
    return np.clip((z @ weights / COSINE - LOW) / (HIGH - LOW), 0, 1) * BINS


def isotonic(rows: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """(centres, values) of the pools of (bin, rows, rows of label 1): values never fall from pool to pool."""
    pools: list[list[float]] = []  # weight, ones, sum of centres
    for at, n, ones in sorted(rows):
        pools.append([n, ones, n * (at + 0.5)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [c / n for n, _, c in pools], [ones / n for n, ones, _ in pools]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all rows of docs."""
    rows = stored(measured(docs, id_col, text), "statistics")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    train = stored(rows.where("fold != 0").join(known, F.col("doc_id") == F.col("_id")).select("fold", "x", "y"), "training")

    # sums of integers, so exact
    moments = [f(F.col("x")[i].cast("decimal(38,0)")) for i in range(len(NAMES)) for f in (lambda x: F.sum(x), lambda x: F.sum(x * x))]
    n, *sums = map(int, (x or 0 for x in train.agg(F.count("*"), *moments).first()))
    kind = dict(rows.dtypes)["doc_id"]
    if not n:
        return rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), F.lit(0.5).alias("score"), F.lit(int(cut <= 0.5)).alias("predicted"))
    mean = [a / n / UNIT for a in sums[::2]]
    deviation = [max((n * b - a * a) ** 0.5 / n / UNIT, 1e-3) for a, b in zip(sums[::2], sums[1::2], strict=True)]
    features = Features(mean, deviation)
    g = normal_equations(train, features)
    whole = sum(g.values())
    final, others = solved(whole), {f: solved(whole - own) for f, own in g.items()}

    def crossed(batches):
        for batch in batches:
            fold, x, y = batch.column(0).to_numpy(), matrix(batch.column(1), len(NAMES)), batch.column(2).to_numpy()
            counts = np.zeros((2, BINS), np.int64)
            for low in range(0, len(y), 4096):
                some = slice(low, low + 4096)
                z = features(x[some])
                for f in np.unique(fold[some]):
                    own = fold[some] == f
                    at = np.minimum(binned(z[own], others[int(f)]).astype(int), BINS - 1)
                    counts[0] += np.bincount(at, minlength=BINS)
                    counts[1] += np.bincount(at, y[some][own], BINS).astype(np.int64)
            at = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["at", "n", "ones"])

    bins = train.select("fold", "x", "y").mapInArrow(crossed, "at long, n long, ones long").groupBy("at").agg(F.sum("n"), F.sum("ones"))
    centres, values = isotonic([tuple(r) for r in bins.collect()])  # BINS rows at most

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), len(NAMES))
            score = np.concatenate([np.zeros(0)] + [np.interp(binned(features(x[low : low + 4096]), final), centres, values) for low in range(0, len(x), 4096)])
            held = batch.column(1).to_numpy() == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "fold", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_quality_classifier": op11}
