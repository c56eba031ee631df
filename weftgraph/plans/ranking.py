"""Global ranks and running sums without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the given order, which must tell rows apart for a stable result.

    A range sort numbers rows inside partitions; only the partitions' sizes are summed up in one place.
    """
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__base"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit(_LOW_BITS))).drop("__at", "__part", "__base")


def sums_before(df: DataFrame, key: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the sum of `value` over all rows with a smaller whole-number `key`; keys are distinct.

    Keys are cut into blocks: sums inside a block are a window of that block, and only block totals meet in one task.
    """
    blocked = df.withColumn("__block", F.floor(F.col(key) / block))
    totals = blocked.groupBy("__block").agg(F.sum(value).alias("__total"))
    bases = totals.select("__block", (F.sum("__total").over(Window.orderBy("__block")) - F.col("__total")).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(key)) - F.col(value)
    return blocked.withColumn("__inside", inside).join(bases, "__block").withColumn(name, F.col("__base") + F.col("__inside")).drop("__block", "__inside", "__base")


def balanced_part(rank: Column, n: Column, parts: int) -> Column:
    """The block of a row at place `rank` of n when places are cut into `parts` runs whose sizes differ by one at most, longer ones first."""
    size, more = F.floor(n / parts), n % parts
    early = more * (size + 1)
    return F.when(rank < early, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - early) / F.greatest(size, F.lit(1)))).cast("int")
