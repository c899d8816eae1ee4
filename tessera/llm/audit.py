"""Filter interaction audit: what five text filters remove, in every order.

A text fails A with fewer than 200 words, B with fewer than 50 different words in 100
(case matters), C with over 3 capitals A-Z in 100 code points, D if it holds any of
`#$%&*|`, E if a row of a smaller doc_id has the identical text, anywhere in the table and
whether removed or not. A to D come from one scan of the Arrow buffers (see `scanning`): byte
classes and their prefix sums give words, capitals and symbols, sorted and verified word
hashes the different words. Each row becomes a mask of the filters it fails.

Copies are found by SHA-256 of the text: the smallest id of each digest is a minimum that is
combined before the shuffle, and rows find whether they are it by a join on digest and id
together, so a digest that a third of all rows share is spread by its ids. Repeated rows are
counted before they move. Masks are then summed by part, 32 masks x 4 labels at most, and
only these sums meet the 600 constant (order, step) pairs.

Null texts are empty, so identical to empty ones; a null lang is the part ''; a row without
id is no copy of any and none is a copy of it; rows that repeat id and text all stand and are
no copies of each other; a document is good (toxic) if any of its labels says so; labels
without id or document count nowhere; an empty table gives no rows. Only doc_id, text and
lang are read, so no column clashes; very long texts are read whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.scanning import scans, together

LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
CLASSES = {"capitals": bytes(range(ord("A"), ord("Z") + 1)), "symbols": SYMBOLS.encode()}


def masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    out = []
    for s in scans(column, CLASSES):
        words, chars, capitals, symbols = s.n_words, *(s.counts[c] for c in ("chars", "capitals", "symbols"))
        fails = {"A": words < LEAST_WORDS, "B": 100 * s.distinct() < DISTINCT_PERCENT * words, "C": 100 * capitals > CAPITALS_PERCENT * chars, "D": symbols > 0}
        out.append(sum(hit * BIT[name] for name, hit in fails.items()))
    return together(out)


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask of A to D) of all rows."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(whole.alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(masks(batch.column(0)).astype(np.int32))], names=["doc_id", "part", "digest", "mask"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, digest binary, mask int")


def labelled_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask of all filters, good, toxic, n): at most 128 rows for each part."""
    rows = stored(scanned(docs, id_col, text, part).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest").where("_first IS NOT NULL")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    found = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left").join(marks, F.col("doc_id") == F.col("_id"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    mask = F.col("mask") + F.when(copy, BIT["E"]).otherwise(0)
    return found.groupBy("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audited(cells: DataFrame) -> DataFrame:
    """One row for each part, filter order and step, from (part, mask, good, toxic, n)."""
    orders = [(order, step, BIT[order[step - 1]], sum(BIT[x] for x in order[: step - 1])) for order in map("".join, permutations(FILTERS)) for step in range(1, len(FILTERS) + 1)]
    steps = cells.sparkSession.createDataFrame(orders, "filter_order string, step int, own int, before int")  # 600 constant rows
    both = cells.crossJoin(F.broadcast(steps))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    # a document that fails k filters is removed by each of them in a kth of all orders
    share = F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count("mask"), F.lit(1))
    n = lambda hit, times=F.lit(1): F.coalesce(F.sum(F.when(hit, F.col("n") * times.cast("long"))), F.lit(0)).cast("long")
    return both.groupBy("part", "filter_order", "step").agg(
        n(~fails & ~earlier).alias("kept"),
        n(fails & ~earlier).alias("removed"),
        n(fails & earlier).alias("redundant"),
        n(F.col("mask") == F.col("own")).alias("unique_fails"),
        n(fails & ~earlier & F.col("good")).alias("good_lost"),
        n(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        n(fails, share).alias("shapley"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(stored(labelled_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "cells"))


#: Filters one by one, orders as permutations by recursion; shapley is the plain sum over all orders.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit,
         length(before) > 0 AND regexp_matches(fails, '[' || before || 'z]') AS earlier FROM c, s),
g AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (hit AND NOT earlier AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (hit AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""

QUERIES = {"op13_filter_audit": op13}
ORACLE = {"op13_filter_audit": OP13_SQL}
