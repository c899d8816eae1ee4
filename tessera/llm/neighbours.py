"""Approximate nearest neighbours by cross-polytope hashing.

Each of `tables` pseudo-rotations (three rounds of random signs and a fast Hadamard
transform, padded to a power of two) assigns a vector to its nearest signed axis; a query
probes the `probes` nearest axes of each table. Candidates are scored by their exact inner
product in double precision on the original vectors. Queries that find fewer than k, though
there are more, probe again: four times the axes, then every axis, which is every entry.

Vectors are hashed in ranges of norms, powers of two whose bounds lie between them, so that
a few long vectors don't hide the directions of the others. In a range they are scaled by
its largest norm and get one more coordinate that makes their norm one (queries: their
direction and zero), so the largest inner product becomes the smallest angle; queries go
to every range.

The index is dealt by rows, not by axes: each slice of about `SLICE_BYTES` of vectors is
shuffled once, in its own precision, holds all its tables in memory and answers every
query, which are few against the rows. A slice sends only the k best of each query. Which
entries are candidates doesn't depend on the slices, and no axis, vector or id is a group
of the shuffle, so none of them can be hot; equal vectors of a slice are one entry with
their k + 1 smallest ids, as ties go to smaller ids.

Vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of other lengths aren't candidates; fewer than k candidates give fewer rows;
repeated (id, vector) rows count once; an empty table gives an empty result; only the id
and the vector are read. The index needs no fitting: every row is indexed. Measured recall
is in the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

K, TABLES, PROBES, SLICE_BYTES, SEED = 20, 16, 16, 64 << 20, 7
#: Slices are made smaller for the sake of idle cores, down to so many rows; queries are scored in blocks.
LEAST_ROWS, BLOCK = 1024, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    n, width, half = *x.shape, 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def axes(unit: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The nearest signed axes (axis, or axis + width if negative) of each row; the nearest first if it is one."""
    width = 1 << (unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng((SEED, number, width))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    if probes == 1:
        at = np.abs(x).argmax(axis=1)
        return (at + width * (x[np.arange(len(x)), at] < 0))[:, None]
    both = np.concatenate([x, -x], axis=1)
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes < 2 * width else np.tile(np.arange(2 * width), (len(x), 1))


def norm_of(vec):
    """The norm, by way of the largest component, so that no square over- or underflows."""
    top = F.array_max(F.transform(vec, F.abs)).cast("double")
    # a lambda over one element takes top once, not for each component
    return F.transform(F.array(top), lambda t: t * F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + (x / t) * (x / t))))[0]


class Slice:
    """Vectors of one length with their tables: for each range of norms, the axes of its entries."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, span: np.ndarray, most: np.ndarray, tables: int, k: int):
        rows = np.ascontiguousarray(vec + 0.0)  # one zero
        keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        order = np.lexsort((ids, np.unique(keys, return_inverse=True)[1].ravel()))
        new = np.ones(len(order), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        entry = np.cumsum(new) - 1
        first = np.nonzero(new)[0]
        kept = np.arange(len(order)) - first[entry] <= k
        self.ids, entry = ids[order][kept], entry[kept]
        self.starts = np.searchsorted(entry, np.arange(len(first)))
        self.counts = np.bincount(entry, minlength=len(first))
        chosen = order[first]
        self.vec = vec[chosen].astype(float)
        self.parts = []
        for r in np.unique(span[chosen]):
            here = np.nonzero(span[chosen] == r)[0]
            scaled = self.vec[here] / most[chosen][here][:, None]
            unit = np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))], 1)
            self.parts.append((here, [axes(unit, t, 1)[:, 0] for t in range(tables)]))

    def candidates(self, queries: np.ndarray, probes: int, width: int) -> np.ndarray:
        """Whether an entry (column) shares an axis that a query (row) probes, in any table."""
        if probes >= 2 * width:
            return np.ones((len(queries), len(self.vec)), bool)
        big = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit = np.concatenate([big / np.linalg.norm(big, axis=1, keepdims=True), np.zeros((len(big), 1))], 1)
        found, column = np.zeros((len(self.vec), len(queries)), bool), np.arange(len(queries))
        for t in range(len(self.parts[0][1])):
            probed = np.zeros((2 * width, len(queries)), bool)
            probed[axes(unit, t, probes).T, column] = True
            for here, owned in self.parts:
                if len(here) == len(found):
                    found |= probed[owned[t]]
                else:
                    found[here] |= probed[owned[t]]
        return np.ascontiguousarray(found.T)

    def best(self, qid: np.ndarray, queries: np.ndarray, probes: int, k: int):
        """(query, id, score) of the k best candidates for each query."""
        found = self.candidates(queries, probes, 1 << queries.shape[1].bit_length())
        if 16 * np.count_nonzero(found) > found.size:
            rough = np.where(found, queries @ self.vec.T, -np.inf)
        else:
            row, col = np.nonzero(found)
            rough = np.full(found.shape, -np.inf)
            rough[row, col] = np.einsum("ij,ij->i", queries[row], self.vec[col])
        want = min(k + 1, rough.shape[1])
        floor = -np.partition(-rough, want - 1, axis=1)[:, want - 1]
        low = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)
        row, col = np.nonzero(found & (rough >= low[:, None]))
        score = (queries[row] * self.vec[col]).sum(axis=1)
        times = self.counts[col]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q, v, s = np.repeat(qid[row], times), self.ids[np.repeat(self.starts[col], times) + inner], np.repeat(score, times)
        return best(q[q != v], v[q != v], s[q != v], k)


def best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct (q, v, s) of each q, ties to smaller v."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[new], v[new], s[new]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k], s[place < k]


def sliced(entries: DataFrame, queries: DataFrame, slices: int, tables: int, probes: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best candidates of each slice for each query."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int")
    given = entries.select(salt.alias("slice"), "dim", F.lit(0).alias("kind"), "id", "vec", "range", "most")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    asked = queries.select(every.alias("slice"), "dim", F.lit(1).alias("kind"), "id", "vec", F.lit(0).alias("range"), F.lit(0.0).alias("most"))
    dealt = given.union(asked).repartition(slices, "slice").sortWithinPartitions("slice", "dim", "kind")

    def run(batches):
        now, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                some, dim = batch.slice(a, b - a), int(keys[a, 1])
                if (here := tuple(keys[a, :2])) != now:
                    now, held, index = here, [], None
                vec = some.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                ids = some.column(3).to_numpy()
                if not keys[a, 2]:
                    held.append((ids, vec, some.column(5).to_numpy(), some.column(6).to_numpy()))
                elif held:
                    index = index or Slice(*(np.concatenate(x) for x in zip(*held, strict=True)), tables, k)
                    for low in range(0, len(vec), BLOCK):
                        found = index.best(ids[low : low + BLOCK], vec[low : low + BLOCK].astype(float), probes, k)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, tables: int = TABLES, probes: int = PROBES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by inner product."""

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
        df = df.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return df.where(F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))

    spark = rows.sparkSession
    entries = sound(rows).withColumn("norm", norm_of(F.col("vec"))).withColumn("range", F.round(F.log2("norm")).cast("int"))
    # one row for each length of vectors and power of two
    ranges = stored(entries.groupBy("dim", "range").agg(F.max("norm").alias("most"), F.count("*").alias("n")), "ranges")
    size = ranges.agg(F.sum("n"), F.sum(F.col("n") * F.col("dim") * 8)).first()
    n, octets = size[0] or 0, size[1] or 0
    slices = max(1, -(-octets // slice_bytes), min(n // LEAST_ROWS, 2 * spark.sparkContext.defaultParallelism))
    entries = entries.join(F.broadcast(ranges.drop("n")), ["dim", "range"])
    there = F.broadcast(ranges.groupBy("dim").agg(F.sum("n").alias("there")))

    asking, hits = sound(queries).distinct(), None
    for some, each in ((tables, probes), (tables, 4 * probes), (1, 1 << 30)):
        found = stored(sliced(entries, asking, slices, some, each, k), "hits")
        hits = found if hits is None else hits.union(found)
        had = hits.groupBy("query_id").agg(F.count_distinct("vec_id").alias("had"))
        short = asking.join(had, asking["id"] == had["query_id"], "left").join(there, "dim")
        # rows of the query's own id are no candidates, so a table of few rows may be asked once in vain
        asking = stored(short.where(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.col("there") - 1)).select("id", "vec", "dim"), "short")
        if asking.isEmpty():
            break

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = hits.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return hits.groupBy("query_id", "rank").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), rows).select("query_id", "rank", "vec_id", "score")


QUERIES = {"op6_cross_polytope": op6}
