"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Size of a document: its words. Sources in code point order (null last) weigh 5, 2, 1,
repeating, and share the words of all documents; no target exceeds `repeats` times its
source's size, and what is above is shared again by weight until none is above.

A source takes whole epochs first: every document as often as the target covers the
source. The rest of the budget goes to documents in ascending order of their exponential
keys -ln(u) / quality, until the budget is full; the one document at the edge gives only
as many of its words as still fit, so a source misses its target by under one word. u
comes from an MD5 of the id, so reruns agree. Quality is a column of the caller's (0.05 at
least; null: 0.05); by default the share of a text's characters that aren't symbols.

No source is sorted as a whole: the range of its keys is cut into SLOTS equal slices, whose
sizes (sums, combined before the shuffle) are prefix-summed for each source; the slice where
the budget ends is cut again, until it has at most EDGE rows or one key, and only these are
sorted. So it doesn't matter how keys are spread, and each round reads ids and sizes only.

Null texts have size 0 and take nothing; a null source is a source of its own; equal keys
(repeated rows) come in order of size and are cut as if they were one list, so rows of one
id, source and size share their words: copies are numbered, and so many first ones get the
whole, the next one the rest. An empty table gives an empty result; rows pass through
whole, so no column clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered, stored, table, word_count

WEIGHTS, REPEATS, SLOTS, EDGE = (5, 2, 1), 3, 4096, 4096


def clean_share(text: Column) -> Column:
    """The share of a text's characters that aren't symbols."""
    given = F.coalesce(text, F.lit(""))
    return 1 - (F.length(given) - F.length(F.translate(given, "#*$%&|<>", ""))) / F.greatest(F.length(given), F.lit(1))


def sizes(docs: DataFrame, id_col: str, text: str, source: str, quality: Column | None = None) -> DataFrame:
    """(doc_id, source, size, key) of all rows."""
    quality = F.greatest(F.lit(0.05), clean_share(F.col(text)) if quality is None else quality.cast("double"))
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    key = -F.log((bits + F.lit(0.5)) / F.lit(2.0**52)) / quality
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))


def edges(sized: DataFrame, goal: DataFrame, slots: int = SLOTS, most: int = EDGE) -> DataFrame:
    """(s, low, high, before) for each source with a budget to reach: the range of keys where it ends, and the words before it.

    goal: (s, budget). A range has at most `most` rows, or one key.
    """
    every = sized.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    state = every.join(goal.select("s", "budget"), F.col("source").eqNullSafe(F.col("s"))).where("budget > 0")
    state = stored(state.select("s", "budget", "low", "high", F.lit(0).cast("long").alias("before"), "n"), "edges")
    while True:
        wide = state.where((F.col("n") > most) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            return state.select("s", "low", "high", "before")
        rows = sized.join(wide, F.col("source").eqNullSafe(F.col("s"))).where("key BETWEEN low AND high")
        slot = F.least(F.lit(slots - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * slots)).cast("int")
        cut = rows.groupBy("s", "budget", "before", slot.alias("slot")).agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
        # at most as many rows a source as there are slots
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("slot"))
        cut = cut.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("words")).where("start < budget AND upto >= budget")
        cut = cut.select("s", "budget", "low", "high", F.col("start").alias("before"), "n")
        state = stored(state.where((F.col("n") <= most) | (F.col("low") >= F.col("high"))).unionByName(cut), "edges", instead=state)


def targets(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): the words of all rows, shared by weight under the caps."""
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "rank")
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    sources = stored(sources.select("source", "source_size", "weight", (F.col("source_size") * repeats).alias("most")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, capped = None, -1
    while True:  # each round caps at least one more source, or is the last
        full = F.lit(False) if share is None else F.col("weight") * share >= F.col("most")
        row = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if not row[1] or row[2] == capped:
            break
        share, capped = (total - row[0]) / row[1], row[2]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(share or 0.0), F.col("most").cast("double")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, repeats: int = REPEATS, quality: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, epochs, part, taken.

    epochs: whole takes; part: words of one more take; taken: epochs x size + part.
    """
    sized = stored(sizes(docs, id_col, text, source, quality), "sizes")
    goal = targets(sized, weights, repeats)
    safe = F.greatest(F.col("source_size"), F.lit(1))
    goal = goal.withColumn("epochs", F.floor(F.col("target") / safe).cast("long"))
    goal = goal.withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    goal = stored(goal.withColumnRenamed("source", "s"), "targets")

    ends = edges(sized, goal).withColumnRenamed("s", "s2")
    goal = stored(goal.join(ends, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "goals")

    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("s")))
    here = F.coalesce((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")), F.lit(False))
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.where(here).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - F.col("upto") + F.col("size")))
    cut = cut.withColumn("part", part).drop("upto")
    whole = rows.where(~here).withColumn("part", F.when(F.col("key") < F.col("low"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = cut.unionByName(whole)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; a part comes cut after its words."""
    by = ["doc_id", "source", "size"]
    plan = mixed(docs, id_col, text, source, **how).groupBy(*by).agg(F.max("epochs").alias("epochs"), F.min("part").alias("low"), F.max("part").alias("part"), F.sum("part").alias("parts"))
    plan = stored(plan.where((F.col("epochs") > 0) | (F.col("part") > 0)).where("size > 0"), "plan")
    rows = docs.select(F.struct("*").alias("row")).withColumn("n_words", word_count(F.col("row")[text]))
    mine = F.col("row")[id_col].eqNullSafe(plan["doc_id"]) & F.col("row")[source].eqNullSafe(plan["source"]) & (F.col("n_words") == plan["size"])
    even = rows.join(plan.where("low = part").hint("merge"), mine).select("row", "size", "epochs", "part")  # one plan at every size, and it spills

    # where copies straddle a source's edge they are numbered: by the stored partition, then inside it
    split = plan.where("low < part")
    if not split.isEmpty():
        copies = stored(rows.join(split, mine).select("row", *by, "epochs", "parts", F.monotonically_increasing_id().alias("at")), "copies").withColumn("place", F.shiftright("at", 33))
        counts = copies.groupBy(*by, "place").agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("place")) - F.col("n")).select(*(F.col(c).alias(f"c_{c}") for c in by), F.col("place").alias("c_place"), "before")
        number = F.row_number().over(Window.partitionBy(*by, "place").orderBy("at"))
        same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in [*by, "place"]]
        copies = copies.withColumn("number", number).join(counts, same)
        given = F.col("parts") - (F.col("before") + F.col("number") - 1) * F.col("size")
        even = even.unionByName(copies.select("row", "size", "epochs", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), given)).alias("part")))

    takes = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    out = even.where(takes > 0).withColumn("take", F.explode(F.sequence(F.lit(1).cast("long"), takes)))
    short = (F.col("take") > F.col("epochs")) & (F.col("part") < F.col("size"))
    whole = F.col("row")[text]
    words = F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    begin = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    return out.select(*[(F.when(short, begin).otherwise(whole) if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_source_mix": op7}
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / greatest(0.05::DOUBLE, 1 - length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
step(k, share) AS (
  SELECT 0, (SELECT sum(n)::DOUBLE / sum(w) FROM s)
  UNION ALL
  SELECT k + 1, (SELECT ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) FILTER (w * share >= 3 * n), 0))::DOUBLE / sum(w) FILTER (w * share < 3 * n) FROM s)
  FROM step WHERE k < 40),
lvl AS (SELECT max(share) AS share FROM step),
goal AS (SELECT source, n, least(w * share, (3 * n)::DOUBLE) AS target FROM s, lvl),
b AS (SELECT *, floor(target / greatest(n, 1))::BIGINT AS e, floor(target)::BIGINT - floor(target / greatest(n, 1))::BIGINT * n AS budget FROM goal),
r AS (SELECT doc_id, size, n, target, e, budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target, (e * size + greatest(0, least(size, budget - upto + size)))::BIGINT AS taken FROM r
"""
ORACLE = {"op7_source_mix": OP7_SQL}
