"""Connected components by star contraction, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, shuffled, stored


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
    return row["n"], row["h"] or 0


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge; a root is its component's least node.

    edges: (u, v) of any one type; order, repeats and loops do not matter. Large-star
    hangs a node's greater neighbours on the least node that it sees, small-star the
    smaller ones; they alternate until no edge moves. Rounds grow with the logarithm of
    a component's size, and no component is ever gathered in one place. Each round is
    written to the shared folder, so that a lost executor costs one round at most; no
    table is broadcast, since the driver would hold it.
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(shuffled(small_least), "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        last, before = seen, now
        now = stored(small.where("u != v").distinct())
        discard(before)
        seen = _signature(now)
        if seen == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
