"""Edges from a stream of events: an extension, as the batch operators have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, id, deg from a stream of (ts, src, dst): arcs of each vertex in each event-time window, both ways.

    Rows later than the watermark are left out; state is kept by (window, vertex), and counts are combined before the shuffle.
    """
    both = events.withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    return both.groupBy(F.window("ts", window).alias("w"), "id").agg(F.count("*").alias("deg")).select(F.col("w.start").alias("window_start"), "id", "deg")
