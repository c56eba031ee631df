"""Sparse matrices in coordinate form (i, j, v) and their products with vectors (j, x)."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import draw, fraction
from weftgraph.operators.graph import symmetrize
from weftgraph.operators.order import relabel
from weftgraph.plans.lineage import cut
from weftgraph.plans.ranking import sums_before


def mirrored(coo: DataFrame, kind: str = "symmetric") -> DataFrame:
    """A whole matrix from one triangle; skew matrices are negated across the diagonal, Hermitian ones conjugated (im: imaginary parts)."""
    if kind == "general":
        return coo
    sign = {"v": -1 if kind == "skew-symmetric" else 1, "im": -1 if kind in ("skew-symmetric", "hermitian") else 1}
    values = [(F.col(c) * sign[c]).alias(c) for c in ("v", "im") if c in coo.columns]
    return coo.unionByName(coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def sorted_coo(coo: DataFrame) -> DataFrame:
    return coo.orderBy("i", "j")


def is_sorted(coo: DataFrame, line: str = "line") -> DataFrame:
    """sorted: whether entries are in (i, j) order by line; neighbours meet inside blocks of lines and at their borders."""
    size = 1 << 16
    last = coo.groupBy(F.floor(F.col(line) / size).alias("b")).agg(F.max_by(F.struct("i", "j"), line).alias("last"), F.min_by(F.struct("i", "j"), line).alias("first"))
    borders = last.select((F.lag("last").over(Window.orderBy("b")) > F.col("first")).alias("bad"))
    inside = coo.select((F.lag(F.struct("i", "j")).over(Window.partitionBy(F.floor(F.col(line) / size)).orderBy(line)) > F.struct("i", "j")).alias("bad"))
    return borders.unionByName(inside).agg((~F.coalesce(F.bool_or("bad"), F.lit(False))).alias("sorted"))


def row_pointers(coo: DataFrame, rows: DataFrame) -> DataFrame:
    """i, ptr: entries of all smaller rows. rows: i."""
    counted = rows.join(coo.groupBy("i").agg(F.count("*").alias("n")), "i", "left").na.fill(0, ["n"])
    return sums_before(counted, "i", "n", "ptr").select("i", "ptr")


def spmv(coo: DataFrame, x: DataFrame, rows: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """i, y: alpha A x + beta y for every row of `rows`, 0 for empty ones; products are summed before the shuffle by row."""
    product = coo.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("p"))
    out = rows.join(product, "i", "left").withColumn("p", F.coalesce("p", F.lit(0.0)) * alpha)
    if y is None or beta == 0:
        return out.select("i", F.col("p").alias("y"))
    return out.join(y.select("i", F.col("y").alias("old")), "i", "left").select("i", (F.col("p") + beta * F.coalesce("old", F.lit(0.0))).alias("y"))


def vector(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """j, x: n ones, or, with a seed, numbers in [-1, 1) drawn for each place."""
    x = F.lit(1.0) if seed is None else fraction(draw(F.col("id"), 0, 0, seed)) * 2 - 1
    return spark.range(n).select(F.col("id").alias("j"), x.alias("x"))


def timed_products(coo: DataFrame, x: DataFrame, rows: DataFrame, times: int = 1000) -> DataFrame:
    """times, seconds: how long so many products take together, after one that isn't counted. coo and x are read from a checkpoint each time."""
    coo, x = cut(coo), cut(x)
    began = 0.0
    for k in range(times + 1):
        began = time.perf_counter() if k == 1 else began
        spmv(coo, x, rows).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began if times else 0.0
    return coo.sparkSession.createDataFrame([(times, seconds)], "times int, seconds double")


def spy(coo: DataFrame, cells: int, n: int) -> DataFrame:
    """row, col, n: entries in each cell of a cells x cells picture of an n x n matrix."""
    cell = lambda c: F.floor(F.col(c) * cells / n).cast("int")
    return coo.groupBy(cell("i").alias("row"), cell("j").alias("col")).agg(F.count("*").alias("n"))


def spy_orders(edges: DataFrame, orders: dict[str, DataFrame], cells: int, n: int) -> DataFrame:
    """ordering, row, col, n: the picture of the edges (both ways) under each vertex order (id, rank)."""
    made = [spy(symmetrize(relabel(edges, ranked)).select(F.col("src").alias("i"), F.col("dst").alias("j")), cells, n).select(F.lit(name).alias("ordering"), "row", "col", "n") for name, ranked in orders.items()]
    return reduce(DataFrame.unionByName, made)
