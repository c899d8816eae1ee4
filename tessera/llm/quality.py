"""Quality rules: base counts of each text, and lines that too many documents of a host share.

Base counts follow the words `[^\\x20\\x09-\\x0D]+` of the whole text (null: no words).
base_failed: under 50 words, or over half of the words stand in 3-word windows that the
text holds twice or more.

Line frequency: lines are normalised (lower case, one space between words), hashed to 64
bits and counted by distinct documents of a host. A line is removed if over
max(line_floor, line_share x the host's documents) of them hold it: the share is small, as
boilerplate stands in a tenth or so of a host's documents, whatever their number. Removed
lines leave the text (`cleaned`), which keeps its other lines as they are. A document that
this leaves with fewer words than the base rules ask for, or less than `left_share` of its
words, is depleted and is rejected: without its template it would have failed. With `copies_once` exact copies of a text count as
one document of the host, for corpora that are deduplicated afterwards.

Null texts and texts without words have no lines and fail the base rules; a null host is
a host of its own; rows that repeat an id are one document (those without id: one for each
text), judged alike and all returned; a text all of whose lines go is empty, and depleted; an
empty table gives an empty result. Columns of the input never clash, as only id, text and
host are read, and other columns pass through whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import stored, table

LEAST_WORDS = 50
LINE_FLOOR, LINE_SHARE, LEFT_WORDS, LEFT_SHARE = 20, 0.01, LEAST_WORDS, 0.3

SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACES = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first place included."""
    if len(words) < 4:
        return 0
    triples = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(triples)
    if len(seen) == len(triples):
        return 0
    hit = np.fromiter((seen[x] > 1 for x in triples), bool, len(triples))
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(triples)] |= hit
    return int(inside.sum())


def line_hash(line: str) -> int:
    """64 bits of a line in lower case with one space between words."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().encode("utf-8", "surrogatepass").split())) - (1 << 63)


def measured(text: str | None) -> tuple[list[int], dict[int, int]]:
    """The base counts, and the words in all lines with each normalised line's hash."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen, again = Counter(), set(), 0
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").split()
        if parts:
            again += line in seen
            seen.add(line)
            lines[line_hash(line)] += len(parts)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return [len(words), chars, len(SYMBOLS.findall(text)), again, repeat_words(words)], lines


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text) -> row_id, doc_id, host, the base counts, text_hash and the lines."""

    def run(batches):
        for batch in batches:
            rows = [measured(x) for x in batch.column(3).to_pylist()]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(5)]
            sizes = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
            hashes = pa.array([h for r in rows for h in r[1]], pa.int64())
            inside = pa.array([n for r in rows for n in r[1].values()], pa.int64())
            lines = pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([hashes, inside], ["h", "w"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), *counts, lines],
                names=["row_id", "doc_id", "host", "text_hash", *(c.split()[0] for c in COUNTS.split(", ")), "lines"],
            )

    given = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "host", "text", F.xxhash64("text").alias("text_hash"))
    kinds = dict(docs.dtypes)
    return given.mapInArrow(run, f"row_id long, doc_id {kinds['doc_id']}, host {kinds['host']}, text_hash long, {COUNTS}, lines array<struct<h: long, w: long>>")


def frequent_lines(measured_docs: DataFrame, floor: int, share: float, copies_once: bool = False) -> DataFrame:
    """(host, h) of lines that too many documents of a host hold.

    Lines are first counted by rows, which only needs sums combined before the shuffle;
    what can't pass the floor goes there, so exact distinct counts are taken of few lines.
    """
    document = F.struct(F.when(F.lit(not copies_once), F.col("doc_id")).alias("id"), F.when(F.col("doc_id").isNull() | F.lit(copies_once), F.col("text_hash")).alias("hash"))
    lines = measured_docs.select("host", document.alias("document"), F.explode("lines.h").alias("h"))
    likely = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > floor).select(F.col("host").alias("lh"), "h")
    likely = stored(likely, "likely-lines")
    held = lines.join(likely, (lines["host"].eqNullSafe(likely["lh"])) & (lines["h"] == likely["h"])).select("host", lines["h"], "document")
    counted = held.distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
    hosts = measured_docs.select("host", document.alias("document")).distinct().groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "hh")
    limit = F.greatest(F.lit(floor).cast("double"), F.col("host_docs") * share)
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["hh"])).where(F.col("docs") > limit).select("host", "h", "docs")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_floor: int = LINE_FLOOR,
    line_share: float = LINE_SHARE,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
    copies_once: bool = False,
) -> DataFrame:
    """One row for each row of docs: ids, host, base counts, gone (hashes of the lines that go; null: none), n_removed_words, base_failed, kept."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    seen = stored(measures(given), "measures")
    often = stored(frequent_lines(seen, line_floor, line_share, copies_once).select(F.col("host").alias("fh"), F.col("h").alias("fl")), "frequent-lines")
    lines = seen.select("row_id", "host", F.explode("lines").alias("l"))
    removed = lines.join(often, lines["host"].eqNullSafe(often["fh"]) & (F.col("l.h") == often["fl"]))
    # as many hashes as a document has such lines
    removed = removed.groupBy("row_id").agg(F.sum("l.w").alias("removed"), F.array_sort(F.collect_set("l.h")).alias("gone"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < left_words) | (left < F.col("n_words") * left_share))
    out = seen.join(removed, "row_id", "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0).cast("long")))
    out = out.withColumn("n_removed_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "gone", "n_removed_lines", "n_removed_words", "base_failed", "kept"
    )


@F.arrow_udf(StringType())
def without_lines(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines of these hashes; null where nothing goes."""
    out = []
    for body, hashes in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        if body is None or hashes is None:
            out.append(None)
            continue
        drop = set(hashes)
        out.append("\n".join(x for x in body.split("\n") if not x.strip(" \t\n\x0b\x0c\r") or line_hash(x) not in drop))
    return pa.array(out, pa.string())


def beside(docs: DataFrame, verdicts: DataFrame, id_col: str, text: str, host: str, how: str) -> DataFrame:
    """(row, clean, v): each row of docs as a struct, its text without the lines that go, and its verdict (a struct; null: none)."""
    decided = verdicts.dropDuplicates(["doc_id", "host", "text_hash"]).select(F.struct("*").alias("v")).hint("merge")  # one plan at every size, and it spills
    rows = docs.select(F.struct("*").alias("row"))
    at = F.col("row")
    mine = at[id_col].eqNullSafe(F.col("v.doc_id")) & at[host].eqNullSafe(F.col("v.host")) & F.xxhash64(at[text]).eqNullSafe(F.col("v.text_hash"))
    found = rows.join(decided, mine, how)
    # texts that stay whole don't go to Python
    body = F.when(F.col("v.gone").isNotNull(), at[text])
    return found.select("row", F.coalesce(without_lines(body, F.col("v.gone")), at[text]).alias("clean"), "v")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **how) -> DataFrame:
    """The rows of docs that the rules keep, their texts without the lines that too many documents of the host share."""
    verdicts = stored(judged(docs, id_col, text, host, **how).where(~F.col("kept") | F.col("gone").isNotNull()).select("doc_id", "host", "text_hash", "gone", "kept"), "verdicts")
    kept = beside(docs, verdicts, id_col, text, host, "left").where(F.coalesce(F.col("v.kept"), F.lit(True)))
    return kept.select(*[(F.col("clean") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = beside(docs, stored(judged(docs), "verdicts"), "doc_id", "text", "source", "inner")
    clean = F.coalesce("clean", F.lit(""))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words", "base_failed", "kept"]
    return rows.select("v.doc_id", *[f"v.{c}" for c in counts], F.length(clean).cast("long").alias("n_clean_chars"), F.md5(clean).alias("clean_md5"))


#: Hashing aside, the rules in SQL; lines are compared as strings, lowered by code point.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
worded AS (SELECT * FROM lines WHERE n > 0),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM worded GROUP BY ALL) GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT doc_id) AS n FROM d GROUP BY source),
often AS (
  SELECT x.source, norm FROM worded x JOIN host h ON x.source = h.source
  GROUP BY x.source, norm, h.n HAVING count(DISTINCT doc_id) > greatest(20::DOUBLE, 0.01::DOUBLE * h.n)),
gone AS (
  SELECT doc_id, sum(n) AS w, count(DISTINCT norm) AS l FROM worded SEMI JOIN often USING (source, norm) GROUP BY doc_id),
clean AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.norm IS NULL OR n = 0), '') AS clean
  FROM lines LEFT JOIN often o ON o.source = lines.source AND o.norm = lines.norm GROUP BY doc_id),
base AS (
  SELECT d.doc_id, clean, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(gone.l, 0) AS n_removed_lines, coalesce(gone.w, 0) AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id) JOIN clean USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_removed_lines::BIGINT AS n_removed_lines, n_removed_words::BIGINT AS n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 50 OR n_words - n_removed_words < 0.3 * n_words)) AS kept,
       length(clean)::BIGINT AS n_clean_chars, md5(clean) AS clean_md5
FROM base
"""

QUERIES = {"op2_line_frequency_rules": op2}
ORACLE = {"op2_line_frequency_rules": OP2_SQL}
