"""Graph construction and statistics over edges(src, dst[, w]) and arcs(src, dst, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.ranking import global_rank, sums_before


#: Ids that are spelled out from one row.
_BLOCK = 1 << 14


def symmetrize(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Arcs of edges: both ways, duplicates and self-loops kept, or as they are if directed. One pass over the edges."""
    if directed:
        return edges
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.explode(F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.lit(1).alias("side"))))
    return edges.select(*rest, both.alias("x")).select(F.col("x.s").alias("src"), F.col("x.d").alias("dst"), *rest, F.col("x.side").alias("side"))


def size_of(edges: DataFrame) -> tuple[int, int]:
    """(vertices, lines): ids run from 0 to the greatest one, gaps included; (0, 0) without edges."""
    row = edges.agg(F.max(F.greatest("src", "dst")), F.count("*")).first()
    return (0 if row[0] is None else row[0] + 1), row[1]


def domain(edges: DataFrame) -> DataFrame:
    """n, lines in one row."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("n"), F.count("*").alias("lines"))


def vertices(edges: DataFrame) -> DataFrame:
    """id of every vertex from 0 to the greatest one, worked out inside the plan: a query that uses the edges again shares their shuffle.

    Blocks of ids are dealt to shuffle partitions before they are spelled out.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _BLOCK))).alias("block")
    blocks = domain(edges).where("n > 0").select("n", block).repartition(parts, "block")
    return blocks.select(F.explode(F.sequence(F.col("block") * _BLOCK, F.least((F.col("block") + 1) * _BLOCK, F.col("n")) - 1)).alias("id"))


def degrees(ids: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, deg: arcs out of each vertex, 0 for isolated ones."""
    counted = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    return ids.join(counted, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    return degree.groupBy("deg").agg(F.count("*").alias("n"))


def offsets(degree: DataFrame) -> DataFrame:
    """id, deg, off: arcs of all smaller ids."""
    return sums_before(degree, "id", "deg", "off").select("id", "deg", "off")


def slots(arcs: DataFrame, *order: str) -> DataFrame:
    """src, dst, pos: each arc's place among its source's arcs, in the given order of arcs, from 0.

    A global rank less the source's first one, so a hub's arcs are ranked in many tasks.
    """
    ranked = global_rank(arcs, F.col("src"), *(F.col(c) for c in order))
    first = ranked.groupBy("src").agg(F.min("rank").alias("first"))
    return ranked.join(first, "src").select("src", "dst", (F.col("rank") - F.col("first")).alias("pos"))


def packed(placed: DataFrame) -> DataFrame:
    """id, nbrs: adjacency lists in slot order. One row holds a vertex's whole list."""
    return placed.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("nbrs"))


def visit_order(degree: DataFrame) -> DataFrame:
    """id, deg, rank: by degree, then id, both descending."""
    return global_rank(degree, F.desc("deg"), F.desc("id")).select("id", "deg", "rank")


def isolated(ids: DataFrame, arcs: DataFrame) -> DataFrame:
    return ids.join(arcs.select(F.col("src").alias("id")), "id", "left_anti").join(arcs.select(F.col("dst").alias("id")), "id", "left_anti")


def density(degree: DataFrame) -> DataFrame:
    """n, m, density: whole arcs per vertex."""
    return degree.agg(F.count("*").alias("n"), F.sum("deg").alias("m")).withColumn("density", F.floor(F.col("m") / F.col("n")))


def eligible(degree: DataFrame) -> DataFrame:
    """id, deg of vertices that can be merged into a hub: 0 < deg < floor(m / n) + 1."""
    return degree.join(F.broadcast(density(degree).select("density"))).where("deg > 0 and deg < density + 1").select("id", "deg")


def has_edge(pairs: DataFrame, arcs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are arcs."""
    return pairs.join(arcs.select("src", "dst"), ["src", "dst"], "left_semi")


def bandwidth(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0)).alias("bandwidth"))


def two_hop_counts(arcs: DataFrame, degree: DataFrame) -> DataFrame:
    """id, paths: walks of two arcs from each vertex, backtracking included, counted by the middle's degree."""
    return arcs.join(degree.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("deg").alias("paths"))


def two_hop(arcs: DataFrame) -> DataFrame:
    """src, mid, dst of all walks of two arcs; as many rows as the degrees' squares sum to."""
    ahead = arcs.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    return arcs.select("src", F.col("dst").alias("mid")).join(ahead, "mid").select("src", "mid", F.col("far").alias("dst"))


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and duplicates, src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def jaccard(edges: DataFrame) -> DataFrame:
    """src, dst, common, joint, jaccard of each edge of a simple graph.

    Edges are turned from low to high degree, so each triangle is met once, at its lowest vertex, and a hub has few
    forward edges: walks to join are bounded by edges to the power 1.5, not by squared degrees.
    """
    degree = symmetrize(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    known = edges.join(degree.select(F.col("id").alias("src"), F.col("deg").alias("ds")), "src").join(degree.select(F.col("id").alias("dst"), F.col("deg").alias("dd")), "dst")
    low, high = F.struct(F.col("ds").alias("g"), F.col("src").alias("i")), F.struct(F.col("dd").alias("g"), F.col("dst").alias("i"))
    forward = known.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
    wedges = forward.alias("x").join(forward.alias("y"), F.expr("x.a = y.a and x.b < y.b")).selectExpr("x.a.i i", "x.b b", "y.b c")
    closed = wedges.join(forward.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).selectExpr("i", "b.i j", "c.i k")
    sides = closed.select(F.explode(F.array(*(F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("i", "j"), ("i", "k"), ("j", "k"))))).alias("e")).select("e.*")
    common = sides.groupBy("src", "dst").agg(F.count("*").alias("common"))
    found = known.join(common, ["src", "dst"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return found.withColumn("joint", F.col("ds") + F.col("dd") - F.col("common")).select("src", "dst", "common", "joint", (F.col("common") / F.col("joint")).alias("jaccard"))


def mirrored(scored: DataFrame) -> DataFrame:
    """Scores of edges for both directions: a score is worked out once and copied to the reverse arc."""
    rest = [c for c in scored.columns if c not in ("src", "dst")]
    return symmetrize(scored).select("src", "dst", *rest)


def best_neighbour(scored: DataFrame) -> DataFrame:
    """id, best, jaccard: the neighbour with the greatest score over 0, ties by the least id."""
    return scored.where("jaccard > 0").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("jaccard", (-F.col("dst")).alias("o"))).alias("x")).select("id", (-F.col("x.o")).alias("best"), "x.jaccard")
