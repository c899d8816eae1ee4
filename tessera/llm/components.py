"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    edges: two columns of one non-null orderable type; loops and repeats are harmless.
    A large star hangs a node's larger neighbours on the smallest node it knows, a small
    star its smaller ones; both keep the components, and the edges end as one star for
    each component after about log-squared many rounds; edges that are such stars take no
    further round. Each round is written to the shared folder, so a lost executor costs
    one round, and hubs meet only in sums by key (combined before the shuffle) and in
    joins that adaptive execution can split.
    """
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    rounds, most = 0, None
    while True:
        # stars: whoever hangs on a node hangs on just one, and nobody on them
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(now.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        uses = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        loose, count = uses.agg(F.count_if((F.col("up") > 0) & (F.col("n") > 1)), F.coalesce(F.sum("up"), F.lit(0))).first()
        if not loose:
            break
        # rounds are about the square of the logarithm of the edges; many more mean that the input isn't one table
        most = most or 20 + 4 * count.bit_length() ** 2
        if (rounds := rounds + 1) > most:
            raise RuntimeError(f"no stars after {most} rounds")
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u"), F.least("u", "_m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", instead=now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
