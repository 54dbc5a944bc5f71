"""Connected components of a graph of links, by alternating large and small stars.

Each round, every node hooks its larger neighbours (large star), then its smaller ones (small star), to the least node
it knows. Links are summed by key before they are shuffled, and what a hub has found is broadcast to its links where they
are, so no node's links meet in one task. The number of rounds grows with the logarithm of the longest path. Nothing but
two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_one_a_key


def _least(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """Rows (u, v, m): m is the least of u and all of its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    return with_one_a_key(pairs, least, "u", "c", n_pairs).select("u", "v", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node), for every node of ``links`` (a, b); links in any order, repeated or to itself.

    An empty table gives no rows. If they don't settle in ``most_rounds`` the job ends with an error, not with part of them.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        small = _least(large, n)
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(hooked, "round")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen, n = state, state["n"]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
