"""Embedding files, cut reports, result folders and run figures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.order import edge_distances
from weftgraph.sources.binary import BLOCK_BYTES, by_ranges, files_of, join_pieces, read_range, spans, write_pieces
from weftgraph.sources.lines import after, first_line, read_lines


def stem_path(path: str, suffix: str) -> str:
    """path with `suffix` before its extension, or at its end if it has none."""
    return re.sub(r"(\.[^./]*)?$", lambda m: suffix + (m[0] or ""), path, count=1)


def write_text(emb: DataFrame, path: str, dimension: int, order: list | None = None) -> None:
    """`n d`, then `id x1 ... xd ` with six decimals, by id or in the given order (a sorted file)."""
    spark = emb.sparkSession
    numbers = F.concat_ws(" ", F.transform("vec", lambda x: F.format_string("%.6f", x)))
    body = emb.select(F.lit(1).alias("kind"), *(order or [F.col("id").alias("at")]), F.concat_ws(" ", F.col("id").cast("string"), numbers, F.lit("")).alias("value"))
    keys = [c for c in body.columns if c not in ("kind", "value")]
    head = spark.range(1).select(F.lit(0).alias("kind"), *(F.lit(None).cast(body.schema[c].dataType).alias(c) for c in keys), F.lit(f"{emb.count()} {dimension}").alias("value"))
    head.unionByName(body).orderBy("kind", *keys).select("value").write.text(path)


def write_sorted_text(emb: DataFrame, path: str, dimension: int) -> None:
    """As write_text(), by the first coordinate, descending, ties by id."""
    write_text(emb, path, dimension, [(-F.element_at("vec", 1)).alias("at"), F.col("id").alias("tie")])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """id, vec of a text file, or of a folder of part files; the first line of the first file by name is the header and left out."""
    part = F.split(F.trim("value"), r"\s+")
    lines = read_lines(spark, path).where("value <> ''")
    head = first_line(lines)
    rows = lines.where(after(head[1])) if head else lines
    return rows.select(part[0].cast("long").alias("id"), F.transform(F.slice(part, F.lit(2), F.size(part) - 1), lambda x: x.cast("double")).alias("vec"))


def _components(batch: pa.RecordBatch) -> bytes:
    return np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), "<f4").tobytes()


def write_binary(emb: DataFrame, path: str, n: int, dimension: int) -> None:
    """One file: two 32-bit sizes, then n rows of 32-bit floats by id, from pieces that the executors write."""
    join_pieces(path, np.array([n, dimension], "<i4").tobytes(), write_pieces(emb.orderBy("id").select("vec"), _components))


def write_sorted_binary(emb: DataFrame, path: str, n: int, dimension: int) -> None:
    """As write_binary(), by the first coordinate, descending, ties by id."""
    join_pieces(path, np.array([n, dimension], "<i4").tobytes(), write_pieces(emb.orderBy(F.desc(F.element_at("vec", 1)), "id").select("vec"), _components))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """id, vec; id is the place in the file. Read by ranges of rows."""
    ranges = []
    for file in files_of(path):
        n, d = (int(x) for x in np.frombuffer(read_range(file, 0, 8), "<i4"))
        ranges += [(file, a, b, d) for a, b in spans(n, max(1, BLOCK_BYTES // (4 * max(1, d))))]

    def run(span: tuple) -> Iterator[pa.RecordBatch]:
        file, first, last, d = span
        flat = np.frombuffer(read_range(file, 8 + 4 * d * first, 4 * d * (last - first)), "<f4").astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d), pa.int32()), pa.array(flat))], ["id", "vec"])

    return by_ranges(spark, ranges, run, "id long, vec array<double>")


def write_cut(before: int, after: int, path: str) -> None:
    """The two cuts, a line each, beside an output path."""
    with open(stem_path(path, "_CUT"), "w") as out:
        out.write(f"{before}\n{after}\n")


def write_sorted_adjacency(edges: DataFrame, emb: DataFrame, path: str) -> None:
    """`src dst` lines of the edges by the L1 distance of their ends, nearest first, ties by src and dst."""
    lines = edge_distances(edges, emb).orderBy("dist", "src", "dst")
    lines.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)


# Fixed value: how parameters are written into a result's file name.
RESULT_NAME = r"output(\d+)_pos(\d+)_alpha([\d.]+)_neg(\d+)_lr([\d.]+)_sm(\d)_bloom(\d)_CUT\.txt$"


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """graph, pos, alpha, neg, lr, sm, bloom, before, after of each result file of a folder whose name gives parameters."""
    rows = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name()).where(F.col("file").rlike(RESULT_NAME))
    kinds = ("graph int", "pos int", "alpha double", "neg int", "lr double", "sm int", "bloom int")
    names = [F.regexp_extract("file", RESULT_NAME, k + 1).cast(kind.split()[1]).alias(kind.split()[0]) for k, kind in enumerate(kinds)]
    lines = F.split(F.trim("value"), r"\s+")
    return rows.select(*names, lines[0].cast("long").alias("before"), lines[1].cast("long").alias("after"))


def figures(spark: SparkSession, report: dict) -> DataFrame:
    """name, value of a run's figures."""
    return spark.createDataFrame([(k, str(v)) for k, v in report.items()], "name string, value string")
