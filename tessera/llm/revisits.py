"""WARC revisit records of the not-modified profile, resolved to the response they stand for.

Records: record_id, url, ts, kind ('response' or 'revisit'), status, headers (map of
names to values; names in any case), digest. A full response is a 'response' of status
200. A revisit resolves to the latest full response of its canonical URL before it, by
(ts, record_id). Canonical: lower-case host without www. or m., neither scheme nor
default port, no fragment, no tracking parameters, no slash at the end.

Validators: if the revisit names an ETag, it must equal the response's under weak
comparison (W/ is ignored); else, if it names Last-Modified, that must equal the
response's; with neither there is nothing to check and the revisit is 'unvalidated'.
Other outcomes: 'resolved', 'mismatch', 'missing' (no earlier response). The merged
headers of a resolved or unvalidated revisit are the response's, replaced by those that
the revisit carries, except those that describe the body or one connection.

The as-of join needs no row order inside a URL as a whole: time is cut at `slices`
quantiles, each (URL, slice) is a window of its own, and the last response before a slice
comes from one row per (URL, slice). A URL with a third of all captures is thus spread
over all slices, and cut points only steer the work, never the result.

Null urls form one URL, null times come before all others, null headers are empty; equal
times order by record_id; of rows that repeat a record, each revisit is resolved; an
empty table gives an empty result. Only DataFrame functions are used; bodies aren't
moved, as a revisit names its response by record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

#: Fields that a 304 doesn't replace: they describe the stored body, its transfer, or a connection.
FIXED_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
SLICES = 64


def canonical(url: Column) -> Column:
    """The URL's key for comparison; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^(www|m)[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "(?<=[?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/+$", ""))


def lowered(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, the last in name order."""
    sorted_entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(sorted_entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, 1 << 20), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def resolved(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, target_id, target_ts, target_digest, outcome, headers."""
    rows = records.select(
        "record_id",
        F.struct(canonical(F.col("url")).alias("key")).alias("site"),
        "ts",
        "kind",
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
        lowered(F.col("headers")).alias("headers"),
        "digest",
    )
    rows = stored(rows.where("full OR kind = 'revisit'"), "records")
    cuts = rows.select(F.percentile_approx(F.col("ts").cast("double"), [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    rows = rows.withColumn("slice", F.when(F.col("ts").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("ts").cast("double")))))

    place = F.struct("ts", "record_id")
    answer = F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("id"), F.col("digest").alias("digest"), F.col("headers").alias("headers"))
    earlier = Window.partitionBy("site", "slice").orderBy(place, F.col("full").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("answer", F.last(F.when(F.col("full"), answer), ignorenulls=True).over(earlier)).where("kind = 'revisit'")

    ends = rows.groupBy("site", "slice").agg(F.max_by(F.when(F.col("full"), answer), F.when(F.col("full"), place)).alias("end"))
    before = Window.partitionBy("site").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("site", "slice", "carried")
    near = near.join(ends, ["site", "slice"], "left").withColumn("answer", F.coalesce("answer", "carried"))

    field = lambda m, name: F.element_at(m, name)
    strong = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    old, new = F.col("answer.headers"), F.col("headers")
    tag, date = field(new, "etag"), field(new, "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(strong(tag) == strong(field(old, "etag")), F.lit(False)))
    same = same.when(date.isNotNull(), F.coalesce(date == field(old, "last-modified"), F.lit(False)))
    outcome = F.when(F.col("answer").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter(new, lambda k, _: ~k.isin(*FIXED_FIELDS))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    out = near.withColumn("outcome", outcome)
    return out.select(
        "record_id",
        F.col("site.key").alias("url_key"),
        "ts",
        F.col("answer.id").alias("target_id"),
        F.col("answer.ts").alias("target_ts"),
        F.col("answer.digest").alias("target_digest"),
        "outcome",
        F.when(F.col("outcome").isin("resolved", "unvalidated"), F.map_concat(kept, fresh)).alias("headers"),
    )


def captures(pages: DataFrame, lag: int = 1000) -> DataFrame:
    """Crawl records of pages: each page's full response at its page_id, and one not-modified answer.

    What the answer names goes by page_id modulo 6: 0 and 1 the page's ETag, 2 its Last-Modified,
    3 another Last-Modified, 4 nothing; all come `lag` ticks later. 5: its ETag, before any response.
    """
    digest, kind = F.md5(F.coalesce("html", F.lit(""))), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(6))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    etag, day = F.concat(F.lit('"'), digest, F.lit('"')), F.concat(F.lit("day "), F.substring(digest, 1, 2))
    later = F.when(kind == 5, F.lit(-1).cast("long") - F.col("page_id")).otherwise(F.col("page_id") + lag)
    full = F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), day, F.lit("Content-Length"), size, F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Type"), F.lit("text/html"))
    short = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("cache-control"), F.lit("max-age=60"))
    named = F.when(kind.isin(0, 1, 5), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag)))
    named = named.when(kind.isin(2, 3), F.create_map(F.lit("last-modified"), F.concat(day, F.when(kind == 3, "?").otherwise(""))))
    short = F.map_concat(short, F.coalesce(named, F.create_map().cast("map<string,string>")))
    return pages.select(
        F.explode(
            F.array(
                F.struct((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), full.alias("headers"), digest.alias("digest")),
                F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), short.alias("headers"), F.lit(None).cast("string").alias("digest")),
            )
        ).alias("r")
    ).select("r.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolved(captures(table(spark, sf_dir, "pages")))
    names = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "ts", "target_id", "target_ts", "target_digest", "outcome", names.alias("merged"))


QUERIES = {"op1_revisit_resolution": op1}
OP1_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::VARCHAR AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare
  FROM pages),
q AS (
  SELECT page_id, digest, size,
         regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^(www|m)[.]', ''), ':(80|443)$', '')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS key
  FROM p),
r AS (SELECT *, page_id % 6 AS kind, CASE WHEN page_id % 6 = 5 THEN -1 - page_id ELSE page_id + 1000 END AS seen FROM q),
m AS (
  SELECT r.*, f.page_id AS found, f.digest AS digest_of, f.size AS size_of,
         CASE WHEN f.page_id IS NULL THEN 'missing' WHEN kind = 4 THEN 'unvalidated'
              WHEN kind IN (0, 1, 5) AND f.digest = r.digest OR kind = 2 AND f.digest[1:2] = r.digest[1:2] THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM r ASOF LEFT JOIN q f ON r.key = f.key AND r.seen >= f.page_id)
SELECT page_id * 2 + 1 AS record_id, key AS url_key, seen AS ts, found * 2 AS target_id, found AS target_ts, digest_of AS target_digest, outcome,
       CASE WHEN outcome IN ('resolved', 'unvalidated') THEN 'cache-control=max-age=60;content-length=' || size_of || ';content-type=text/html;date=' || seen::VARCHAR
            || ';etag="' || digest_of || '";last-modified=day ' || digest_of[1:2] END AS merged
FROM m
"""
ORACLE = {"op1_revisit_resolution": OP1_SQL}
