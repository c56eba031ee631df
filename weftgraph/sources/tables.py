"""Graphs and matrices from the relational tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.ranking import global_rank


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_part(spark: SparkSession, folder: str) -> DataFrame:
    """Who ordered what: customers, then parts shifted by the number of customers."""
    customers = table(spark, folder, "customer").agg(F.count("*").alias("shift"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    bought = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.join(F.broadcast(customers)).select(F.col("o_custkey").alias("src"), (F.col("shift") + F.col("l_partkey")).alias("dst")).distinct()


def part_supplier(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").agg(F.count("*").alias("shift"))
    return table(spark, folder, "lineitem").join(F.broadcast(parts)).select(F.col("l_partkey").alias("src"), (F.col("shift") + F.col("l_suppkey")).alias("dst")).distinct()


def user_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, w: how often one user's event follows another's in time, directed.

    Events are ranked in time by a range sort, and each is joined with the next rank, so no key gathers many of them.
    """
    ranked = global_rank(table(spark, folder, "events").select("user_id", "ts", "event_id"), F.col("ts"), F.col("event_id"))
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("dst"))
    return ranked.join(after, "rank").where("user_id <> dst").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("w"))


def quantities(spark: SparkSession, folder: str) -> DataFrame:
    """i, j, v: quantity of each part from each supplier."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, vec of the embeddings table."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
