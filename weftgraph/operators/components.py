"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut

#: Links that a task takes; a graph has one task for each so many, so small graphs don't cost many tiny files.
TASK_LINKS = 200_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: each node of the links (a, b) and the least node it reaches. Self-links only name a node.

    Every step joins links with each node's least neighbour, which is a partial minimum, so a hub costs a skewed join
    that adaptive execution splits. About log(longest path) rounds, each cut by a checkpoint.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct()
    named = cut(pairs)
    tasks = 1 + named.count() // TASK_LINKS
    links, before = named.where("u <> v").coalesce(tasks), None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        small = moved.unionByName(least.select("u", F.col("m").alias("v")).coalesce(tasks)).coalesce(tasks)
        links = cut(small.distinct().coalesce(tasks))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # dealt anew, as the rounds leave few partitions
    found = cut(found.unionByName(found.select("component").distinct().select(F.col("component").alias("node"), "component")).repartition("node"))
    alone = named.where("u = v").select(F.col("u").alias("node")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
