"""Lines of text files in the order of files by name and of lines in them, however Spark packs files into tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place of each line; places (file, first byte of the part of the file that a task reads, line of the task) compare as the lines stand."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select("value", place.alias("place"))


def first_line(lines: DataFrame):
    """(value, place) of the first line, or None; a minimum, so nothing is sorted."""
    row = lines.agg(F.min(F.struct("place", "value")).alias("first")).first()
    return None if row["first"] is None else (row["first"]["value"], row["first"]["place"])


def after(place) -> Column:
    """Whether a line stands after the place of another."""
    return F.col("place") > F.struct(F.lit(place["file"]).alias("file"), F.lit(place["start"]).alias("start"), F.lit(place["at"]).alias("at"))
