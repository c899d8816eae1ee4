"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: each text's A-Z are lowered, words (runs of anything but ASCII white space)
are joined by one space into shingles, repeats counted; a bit is set if more than half of
the shingles' XXH64 values (seed 42) set it. Fewer words than a shingle: the whole
sequence is the one shingle; no word, or a null text: fingerprint zero.

Links: fingerprints at `distance` or fewer differing bits. Split into `blocks` blocks,
such a pair agrees on at least blocks - distance whole blocks, so it meets under one of
the C(blocks, distance) keys. Only distinct fingerprints are dealt to keys, so exact
copies of any number are one row. Within a key, all members first link to one
representative (as many rows as members); only members that this leaves outside the
representative's component are compared with the others there, and only pairs between
different components come out. Dense groups thus cost as many rows as members, and no
link between components is lost.

Empty tables give empty results; rows with a null id are linked and labelled like others,
and a component without any id has a null component_id; repeated rows are all returned.
Rows pass through deduplicated() whole, so no column clashes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.components import connected_components

SHINGLE, DISTANCE, BLOCKS, SEED = 3, 3, 6, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        spans = list(zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True))
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(spans), 16384):
        some = spans[k : k + 16384]
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in some), np.uint64, len(some))
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without the text, with fp, the fingerprint as a signed long."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    return docs.select(text, *rest).mapInArrow(run, schema)


def block_keys(fp, distance: int, blocks: int):
    """An array of the keys under which fingerprints meet that agree on blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1) for i in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(parts[i])
        keys.append(F.struct(F.lit(n).alias("t"), key.alias("k")))
    return F.array(*keys)


def linked(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(fp, group) for all nodes (fp distinct, n copies): the smallest fp reachable over links."""
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance
    keyed = nodes.select("fp", "n", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key")).select("fp", "n", "key.t", "key.k")
    heads = keyed.groupBy("t", "k").agg(F.max(F.struct("n", "fp")).alias("head"), F.count("*").alias("members")).where("members > 1")
    mates = stored(keyed.join(heads.select("t", "k", F.col("head.fp").alias("head")), ["t", "k"]).select("t", "k", "fp", "head"), "mates")
    stars = mates.where((F.col("fp") != F.col("head")) & near("fp", "head")).select(F.col("fp").alias("a"), F.col("head").alias("b"))
    first = stored(connected_components(stars), "components")

    mine, heads = first.select(F.col("node").alias("fp"), F.col("component").alias("c")), mates.select("t", "k", "head").distinct()
    heads = heads.join(first.select(F.col("node").alias("head"), F.col("component").alias("hc")), "head", "left")
    heads = heads.select("t", "k", F.coalesce("hc", "head").alias("hc"))
    named = mates.join(mine, "fp", "left").select("t", "k", "fp", F.coalesce("c", "fp").alias("c"))
    others = named.join(heads, ["t", "k"]).where("c != hc").select("t", "k", F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    cross = named.join(others, ["t", "k"]).where((F.col("c") != F.col("c2")) & near("fp", "fp2"))
    second = connected_components(cross.select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct())

    second = second.select(F.col("node").alias("c"), F.col("component").alias("c2"))
    return (
        nodes.select("fp").join(mine, "fp", "left").select("fp", F.coalesce("c", "fp").alias("c")).join(second, "c", "left").select("fp", F.coalesce("c2", "c").alias("group"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row for each row of docs."""
    fps = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), shingle=shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    groups = stored(linked(nodes, distance, blocks), "groups")
    least = nodes.join(groups, "fp").groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = groups.join(least, "group").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """docs with one row of each component: the one of the smallest id (rows without id last), then of the least text hash.

    A component is that of its fingerprints, so an id that stands for several texts neither joins their components nor loses one.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    fps = fingerprints(given, shingle=shingle)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    nodes = stored(fps.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "nodes")
    groups = linked(nodes.select("fp", "n"), distance, blocks)
    kept = nodes.join(groups, "fp").groupBy("group").agg(F.min("first").alias("k")).select(F.struct("k.doc_id").alias("key"), F.col("k.hash").alias("own")).distinct()
    kept = stored(kept, "kept").hint("merge")  # one plan at every size, and it spills
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("key"), F.xxhash64(text).alias("own"), F.struct("*").alias("row"))
    # repeated rows: the one of least hash over all columns that can be hashed; grouped as joined, so texts move once
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    chosen = rows.join(kept, ["key", "own"], "left_semi").groupBy("key", "own").agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in plain))).alias("row"))
    return chosen.select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_near_dedup": op8}
