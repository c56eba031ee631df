"""Edge lists and binary CSR graphs as DataFrames, and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.ranking import global_rank, sums_before
from weftgraph.sources.binary import BLOCK_BYTES, by_ranges, column, files_of, join_pieces, read_range, size_of_file, spans, write_pieces
from weftgraph.sources.lines import read_lines

#: Vertices whose offsets, and arcs whose targets, a task reads at once.
VERTICES, ARCS = 1 << 20, 1 << 20


def read_edge_list(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """src, dst[, w][, line] of text lines `u v [w]`; lines that start with % or # and blank ones are left out.

    Lines that aren't whole numbers raise an error when the table is read. w is null where a line has no third field.
    line: places from 0 in the order of the files' names and of their lines, however many files there are.
    """
    text = read_lines(spark, path).where(~F.col("value").rlike(r"^\s*([%#]|$)"))
    part = F.split(F.trim("value"), r"\s+")
    fields = [part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"), F.get(part, F.lit(2)).cast("double").alias("w")]
    return global_rank(text.select(*fields, "place"), F.col("place"), name="line").drop("place") if lines else text.select(*fields)


def write_edge_list(edges: DataFrame, path: str) -> None:
    fields = [F.col("src").cast("string"), F.col("dst").cast("string")] + ([F.col("w").cast("string")] if "w" in edges.columns else [])
    edges.select(F.concat_ws(" ", *fields).alias("value")).write.text(path)


def distinct_ends(edges: DataFrame) -> DataFrame:
    """id: the vertices that edges name, once each; gaps in the ids don't count."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of files of unsigned 32-bit pairs without a header; a file, or a folder of them, is read by ranges of BLOCK_BYTES."""
    ranges = [(f, a, b) for f in files_of(path) for a, b in spans(size_of_file(f) // 8 * 8, BLOCK_BYTES)]

    def run(span: tuple) -> Iterator[pa.RecordBatch]:
        file, first, last = span
        pairs = np.frombuffer(read_range(file, first, last - first), "<u4").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["src", "dst"])

    return by_ranges(spark, ranges, run, "src long, dst long")


def write_binary_edges(edges: DataFrame, path: str, *order: str) -> None:
    """One file of unsigned 32-bit pairs, in the given order, from pieces that the executors write."""
    rows = edges.select("src", "dst", *(c for c in order if c not in ("src", "dst")))
    ordered = rows.orderBy(*order).select("src", "dst") if order else rows
    join_pieces(path, b"", write_pieces(ordered, lambda batch: np.stack([column(batch, 0, "<u4"), column(batch, 1, "<u4")], 1).tobytes()))


def read_binary_csr(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """src, dst, pos[, w] of a binary CSR file: two 64-bit counts, n 32-bit offsets (the last row ends at m), m targets, m weights.

    Tasks read ranges of VERTICES offsets, and their targets ARCS at a time.
    """
    schema = "src long, dst long, pos long" + ", w long" * weighted
    ranges = []
    for file in files_of(path):
        n, m = (int(x) for x in np.frombuffer(read_range(file, 0, 16), "<i8"))
        ranges += [(file, a, b, n, m) for a, b in spans(n, VERTICES)]

    def run(span: tuple) -> Iterator[pa.RecordBatch]:
        file, first, last, n, m = span
        off = np.frombuffer(read_range(file, 16 + 4 * first, 4 * (min(last + 1, n) - first)), "<u4").astype(np.int64)
        off = np.append(off, m) if last == n else off
        for a in range(int(off[0]), int(off[-1]), ARCS):
            b = min(a + ARCS, int(off[-1]))
            at = np.arange(a, b)
            row = np.searchsorted(off, at, "right") - 1
            made = [row + first, np.frombuffer(read_range(file, 16 + 4 * (n + a), 4 * (b - a)), "<u4").astype(np.int64), at - off[row]]
            if weighted:
                made.append(np.frombuffer(read_range(file, 16 + 4 * (n + m + a), 4 * (b - a)), "<u4").astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["src", "dst", "pos", "w"][: len(made)])

    return by_ranges(spark, ranges, run, schema)


def write_binary_csr(placed: DataFrame, n: int, path: str) -> None:
    """One file from arcs (src, dst, pos[, w]): executors write pieces of the offsets, targets and weights, which are put end to end block by block."""
    counted = placed.sparkSession.range(n).join(placed.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    offsets = sums_before(counted, "id", "deg", "off").orderBy("id").select("off")
    ordered = placed.orderBy("src", "pos")
    arrays = [offsets, ordered.select("dst"), *([ordered.select("w")] if "w" in placed.columns else [])]
    pieces = [p for x in arrays for p in write_pieces(x, lambda batch: column(batch, 0, "<u4").tobytes())]
    join_pieces(path, np.array([n, placed.count()], "<i8").tobytes(), pieces)


def with_lines(edges: DataFrame) -> DataFrame:
    """Edges numbered in (src, dst) order, for tables that have no line order of their own."""
    return global_rank(edges, F.col("src"), F.col("dst"), name="line")
