"""Vector code compression: product codes by integer k-means, searched by ball trees.

Each component x becomes the integer floor(1024 x). Vectors are cut into PARTS equal
consecutive parts; each part position has a codebook of ENTRIES entries, at first that part
of the vectors of smallest ids. A round assigns each part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces each entry by the floor of the mean
of its parts; entries without parts stay. After the last round parts are assigned again.

Assignment searches a ball tree over each codebook, a block of vectors at a time: a greedy
descent gives a first bound, then a depth-first visit takes along the vectors whose ball
isn't farther than their bound. Distances are sums of integer squares and so exact, in
doubles where all of them stay under 2^53 and in 64-bit integers elsewhere; only lower bounds
take roots, rounded down, with radii rounded up, and a ball at just the bound is visited, as
it may hold an entry of lower index. What comes out is counted again in integers.

Codebooks have a fixed size (ENTRIES vectors) and travel with the tasks. A round is one pass:
each task sums its parts by entry, so PARTS x ENTRIES rows leave it, whatever its rows, and
equal vectors, however many, are no group. The integer vectors are stored once for all rounds.

Vectors that are null or hold null or non-finite components are dropped; an empty vector, or
one shorter than the longest, counts as padded with zeros to a multiple of PARTS; components
beyond 2^26 count as that, as distances must fit 64 bits (to 511 components at both extremes).
A null id is last in the order of ids; rows that repeat an id are rows of their own, in order
of their vectors; fewer rows than ENTRIES give as many entries; an empty table gives an empty
result. Only the id, the vector and the label are read, so no column clashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 4, 256, 4, 1024, 1 << 26
LEAF, BLOCK = 16, 4096


def distances(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances (rows of e x rows of q) in 64-bit integers."""
    out = np.empty((len(e), len(q)), np.int64)
    for k, entry in enumerate(e):
        off = q - entry
        out[k] = (off * off).sum(axis=1)
    return out


class Ball:
    """Entries (indices ascending) inside a ball around a point of integers; halves along the widest axis, or a leaf."""

    def __init__(self, book: np.ndarray, index: np.ndarray):
        own = book[index]
        self.index, self.halves = index, ()
        self.centre = own.sum(axis=0) // len(own)
        off = own - self.centre
        self.radius = float(np.nextafter(np.sqrt(float((off * off).sum(axis=1).max())), np.inf)) * (1 + 1e-12)
        spread = own.max(axis=0) - own.min(axis=0)
        if len(index) > LEAF and spread.any():
            order = np.argsort(own[:, spread.argmax()], kind="stable")
            half = len(index) // 2
            self.halves = tuple(Ball(book, np.sort(index[x])) for x in (order[:half], order[half:]))


class Search:
    """Nearest entries of one codebook (entries x width, integers).

    Where doubles hold them, an entry's distance and index are one number, (distance - |q|^2) x
    entries + index, so a least number is a nearest entry of lowest index.
    """

    def __init__(self, book: np.ndarray):
        self.book, self.balls = book, []
        self.most = int(np.abs(book).max(initial=0))

        def numbered(ball: Ball):
            ball.at = len(self.balls)
            self.balls.append(ball)
            for half in ball.halves:
                numbered(half)

        numbered(Ball(book, np.arange(len(book))))
        self.centres = np.stack([x.centre for x in self.balls])
        self.radii = np.array([x.radius for x in self.balls])[:, None]
        own, n = book.astype(float), len(book)
        self.terms = [(-2 * n * own[x.index], ((own[x.index] ** 2).sum(axis=1) * n + x.index)[:, None]) for x in self.balls]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        most, n = max(self.most, int(np.abs(parts).max(initial=0))), len(self.book)
        exact = (4 * parts.shape[1] * most * most + 1) * n < 1 << 53
        if exact:
            q = parts.astype(float)
            norm, centres = (q * q).sum(axis=1), self.centres.astype(float)
            apart = norm - 2 * (centres @ q.T) + (centres * centres).sum(axis=1)[:, None]
            best = np.full(len(q), np.inf)
        else:
            apart = distances(parts, self.centres)
            best, at = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        low = np.maximum(0.0, np.sqrt(apart.astype(float)) * (1 - 1e-12) - self.radii) ** 2 * (1 - 1e-12)
        if exact:
            low = (low - norm) * n - 1  # on the scale of best, rounded down

        def scan(ball: Ball, rows: np.ndarray):
            if exact:
                factors, rest = self.terms[ball.at]
                found = (factors @ q[rows].T + rest).min(axis=0)
                best[rows] = np.minimum(best[rows], found)
                return
            d = distances(parts[rows], self.book[ball.index])
            k = d.argmin(axis=0)  # the first of the least: the lowest index
            d, i = d[k, np.arange(len(rows))], ball.index[k]
            better = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], i[better]

        # down to the leaf on the nearer side at each fork
        todo = [(self.balls[0], np.arange(len(parts)))]
        while todo:
            ball, rows = todo.pop()
            if not len(rows):
                continue
            if not ball.halves:
                scan(ball, rows)
                continue
            a, b = ball.halves
            left = apart[a.at, rows] <= apart[b.at, rows]
            todo += [(a, rows[left]), (b, rows[~left])]
        # then every ball that isn't farther than what was found
        todo = [(self.balls[0], np.arange(len(parts)))]
        while todo:
            ball, rows = todo.pop()
            rows = rows[low[ball.at, rows] <= best[rows]]
            if not len(rows):
                continue
            if ball.halves:
                todo += [(half, rows) for half in ball.halves]
            else:
                scan(ball, rows)
        if exact:
            whole = best.astype(np.int64)
            at, best = whole % n, whole // n + norm.astype(np.int64)
        off = parts - self.book[at]
        error = (off * off).sum(axis=1)
        if not np.array_equal(error, best):
            raise ArithmeticError("distances of the search aren't those of the integers")
        return at, error


def integers(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, c: integer components) of rows whose vectors are sound."""
    given = rows.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    sound = given.where("v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x.cast("double") * SCALE))).cast("int")
    return sound.select("vec_id", "label", F.transform("v", whole).alias("c"))


def blocks(column: pa.Array, parts: int, width: int):
    """(first row, rows x parts x width integers) of blocks of a list column, padded with zeros."""
    for low in range(0, len(column), BLOCK):
        some = column.slice(low, BLOCK)
        sizes = np.diff(some.offsets.to_numpy())
        flat = some.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(some), parts * width), np.int64)
        if (sizes == parts * width).all():
            out = flat.astype(np.int64).reshape(out.shape)
        else:
            row = np.repeat(np.arange(len(some)), sizes)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        yield low, out.reshape(len(some), parts, width)


def sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s_0, s_1, …): numbers of parts nearest to each entry, and their sums by component."""
    parts, entries, width = books.shape
    names = ["part", "entry", "n", *(f"s_{i}" for i in range(width))]

    def run(batches):
        search = [Search(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, block in blocks(batch.column(0), parts, width):
                for p in range(parts):
                    at, _ = search[p].nearest(block[:, p])
                    order = np.argsort(at, kind="stable")
                    own, first, count = np.unique(at[order], return_index=True, return_counts=True)
                    n[p, own] += count
                    total[p, own] += np.add.reduceat(block[order, p], first, axis=0) if width else 0
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, n[p, e], *total[p, e].T)], names=names)

    each = rows.select("c").mapInArrow(run, ", ".join(f"{x} long" for x in names))
    return each.groupBy("part", "entry").agg(*[F.sum(x).alias(x) for x in names[2:]])


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts x entries x width) of rows (vec_id, c)."""
    longest = rows.agg(F.max(F.size("c"))).first()[0] or 0
    width = -(-longest // parts)
    first = [r["c"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "c").limit(entries).collect()]  # at most as many as a codebook has entries
    books = np.zeros((len(first), parts * width), np.int64)
    for k, c in enumerate(first):
        books[k, : len(c)] = c
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        for p, e, n, *s in sums(rows, books).collect():  # one row for each entry at most
            books[p, e] = [x // n for x in s]
    return books


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, c): two hexadecimal digits a part, and the squared distances' sum."""
    parts, _, width = books.shape
    kinds = dict(rows.dtypes)

    def run(batches):
        search = [Search(b) for b in books] if books.shape[1] else []  # no entries: no rows either
        for batch in batches:
            for low, block in blocks(batch.column(2), parts, width):
                found = [search[p].nearest(block[:, p]) for p in range(parts)]
                raw = np.stack([at for at, _ in found], axis=1)
                size = 2 if books.shape[1] <= 256 else 4
                text = raw.astype(f">u{size // 2}").tobytes().hex()
                step = size * parts
                codes = [text[k : k + step] for k in range(0, len(text), step)]
                keys = (batch.column(i).slice(low, len(block)) for i in range(2))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(codes, pa.string()), pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "c").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all sound rows."""
    whole = stored(integers(rows, id_col, vector, label), "integers")
    books = trained(whole, parts, entries, rounds)
    found = stored(assigned(whole, books), "codes")
    # sums are combined before the shuffle; the join's other side is one row a label, broadcast only at a measured size
    labels = stored(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return found.join(labels, found["label"].eqNullSafe(labels["_label"])).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: every distance of every round, as inner products of doubles (exact for integers)."""
    nearest = """(SELECT q.vec_id, q.p, q.x, arg_min(b.e, (q.qq - 2 * list_inner_product(q.x, b.x) + list_inner_product(b.x, b.x)) * 1024 + b.e) AS e,
         min(q.qq - 2 * list_inner_product(q.x, b.x) + list_inner_product(b.x, b.x))::BIGINT AS d FROM q JOIN {book} b ON q.p = b.p GROUP BY ALL)"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED {nearest.format(book=f'b{k}')}")
        steps.append(f"""u{k} AS (SELECT p, e, list(s ORDER BY i) AS x FROM (
            SELECT p, e, i, floor(sum(x[i]) / count(*)) AS s FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS i) GROUP BY ALL) GROUP BY ALL)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN u{k} u USING (p, e))")
    steps.append(f"final AS MATERIALIZED {nearest.format(book=f'b{rounds}')}")
    return f"""
WITH v AS (
  SELECT vec_id, label, [floor(x::DOUBLE * {SCALE}) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS qq FROM (
    SELECT vec_id, p, c[p * len(c) // {parts} + 1 : (p + 1) * len(c) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS p))),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM q QUALIFY e < {entries}),
{", ".join(steps)},
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string([y::BIGINT::VARCHAR FOR y IN x], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""


QUERIES = {"op12_vector_codes": op12}
ORACLE = {"op12_vector_codes": oracle()}
