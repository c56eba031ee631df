"""Matrix Market files: banner, sizes, entries, writers."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import shared_dir
from weftgraph.plans.ranking import global_rank
from weftgraph.sources.binary import BLOCK_BYTES, at_path
from weftgraph.sources.lines import after, first_line, read_lines

# The words of a banner.
OBJECTS, FORMATS = ("matrix",), ("coordinate", "array")
FIELDS, SYMMETRIES = ("real", "complex", "pattern", "integer"), ("general", "symmetric", "hermitian", "skew-symmetric")


class MatrixMarketError(ValueError):
    """A header that isn't one, or a matrix that isn't supported."""


@dataclass(frozen=True)
class Kind:
    object: str = "matrix"
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"

    @property
    def valid(self) -> bool:
        """Known words; no dense pattern, no real Hermitian, no pattern that is Hermitian or skew."""
        known = self.object in OBJECTS and self.format in FORMATS and self.field in FIELDS and self.symmetry in SYMMETRIES
        dense_pattern = self.format == "array" and self.field == "pattern"
        return known and not dense_pattern and not (self.field == "real" and self.symmetry == "hermitian") and not (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))

    @property
    def parts(self) -> int:
        """Numbers that an entry's value has: none in a pattern, two in a complex matrix."""
        return {"pattern": 0, "complex": 2}.get(self.field, 1)

    def __str__(self) -> str:
        return f"{self.object} {self.format} {self.field} {self.symmetry}"


def parse_banner(line: str, strict: bool = True) -> Kind | None:
    """The kind that a first line declares; None for a line that isn't a banner, unless strict."""
    words = line.lower().split()
    if len(words) < 5 or words[0] != "%%matrixmarket":
        if strict:
            raise MatrixMarketError("no Matrix Market banner")
        return None
    kind = Kind(*words[1:5])
    if not kind.valid:
        raise MatrixMarketError(f"unknown kind {kind}")
    return kind


def _opened(spark: SparkSession, path: str, strict: bool) -> tuple[Kind, tuple[int, ...], DataFrame]:
    """Kind, sizes, and the lines after the size line. Lines come by the files' names, so folders of part files read as one file; - is standard input."""
    lines = read_lines(spark, stored_input(spark) if path == "-" else path)
    head = first_line(lines)
    kind = (parse_banner(head[0], strict) if head else None) or Kind()
    rest = lines.where(~F.col("value").rlike(r"^\s*(%|$)"))
    size = first_line(rest)
    if size is None:
        raise MatrixMarketError("no size line")
    sizes = tuple(int(x) for x in size[0].split())
    if len(sizes) != (3 if kind.format == "coordinate" else 2):
        raise MatrixMarketError("bad size line")
    return kind, sizes, rest.where(after(size[1]))


def stored_input(spark: SparkSession) -> str:
    """Standard input as a file in the shared folder, copied block by block."""
    path = f"{shared_dir(spark).rstrip('/')}/input-{uuid.uuid4().hex}.mtx"
    system, at = at_path(path)
    with system.open_output_stream(at) as out:
        while block := sys.stdin.buffer.read(BLOCK_BYTES):
            out.write(block)
    return path


def read_header(spark: SparkSession, path: str, strict: bool = True) -> tuple[Kind, tuple[int, ...]]:
    """Kind and sizes: (rows, columns, entries), or (rows, columns) of a dense array. Without a banner, if not strict, a general real coordinate matrix."""
    return _opened(spark, path, strict)[:2]


def read_matrix(spark: SparkSession, path: str, strict: bool = True, whole: bool = True) -> tuple[DataFrame, Kind, tuple[int, ...]]:
    """(i, j, v[, im]) with ids from 0, kind and sizes. Patterns have 1 everywhere; complex matrices have their imaginary parts in im.

    One triangle is mirrored if whole: skew values negated, Hermitian ones conjugated. A dense array is read column by
    column; of a symmetric one the file has the lower triangle, without the diagonal if it is skew.
    """
    from weftgraph.operators.matrix import mirrored

    kind, sizes, rows = _opened(spark, path, strict)
    part = F.split(F.trim("value"), r"\s+")
    at = 2 if kind.format == "coordinate" else 0
    values = [part[at].cast("double").alias("v")] if kind.parts else [F.lit(1.0).alias("v")]
    values += [part[at + 1].cast("double").alias("im")] if kind.parts == 2 else []
    if kind.format == "coordinate":
        coo = rows.select((part[0].cast("long") - 1).alias("i"), (part[1].cast("long") - 1).alias("j"), *values)
    else:
        placed = global_rank(rows.select("place", *values), F.col("place"), name="k").drop("place")
        coo = placed.select(*dense_place(F.col("k"), sizes[0], kind.symmetry), *(c for c in placed.columns if c != "k"))
    return (mirrored(coo, kind.symmetry) if whole else coo), kind, sizes


def dense_place(k: Column, rows: int, symmetry: str) -> tuple[Column, Column]:
    """Row and column of the k-th value of a dense array, which goes by columns; of a symmetric matrix, by its lower triangle's."""
    if symmetry == "general":
        return (k % rows).alias("i"), F.floor(k / rows).cast("long").alias("j")
    first = 0 if symmetry != "skew-symmetric" else 1
    height = rows - first  # of the first column; each has one less than that before it
    # the columns before j have j * height - j * (j - 1) / 2 values; the root is put right by one where it is rounded
    guess = F.floor((2 * height + 1 - F.sqrt(F.greatest(F.lit((2 * height + 1) ** 2).cast("double") - 8 * k, F.lit(0.0)))) / 2).cast("long")
    before = lambda j: j * height - F.shiftright(j * (j - 1), 1)
    j = F.when(before(guess) > k, guess - 1).when(before(guess + 1) <= k, guess + 1).otherwise(guess)
    return (j + first + k - before(j)).alias("i"), j.alias("j")


def write_matrix(coo: DataFrame, path: str, rows: int, columns: int, kind: Kind | None = None) -> None:
    """Banner, sizes and entries in (i, j) order, ids from 1, values with 17 digits; the first part file has the header.

    Of a symmetric kind give the lower triangle. Complex kinds take the imaginary parts from im; a dense array goes by
    columns, and values that coo lacks are 0.
    """
    kind = kind or Kind()
    spark = coo.sparkSession
    numbers = [F.format_string("%.17g", c) for c in ("v", "im")[: kind.parts]]
    if kind.format == "array":
        first = 1 if kind.symmetry == "skew-symmetric" else 0
        low = F.lit(0) if kind.symmetry == "general" else F.col("j") + first
        cells = spark.range(columns).select(F.col("id").alias("j")).where(low < rows).select(F.explode(F.sequence(low.cast("long"), F.lit(rows - 1).cast("long"))).alias("i"), "j")
        coo = cells.join(coo, ["i", "j"], "left").fillna(0.0)
        head, place, entry = [f"%%MatrixMarket {kind}", f"{rows} {columns}"], ("j", "i"), F.concat_ws(" ", *numbers)
    else:
        head, place = [f"%%MatrixMarket {kind}", f"{rows} {columns} {coo.count()}"], ("i", "j")
        entry = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *numbers)
    body = coo.select(F.lit(1).alias("kind"), F.col(place[0]).cast("long").alias("a"), F.col(place[1]).cast("long").alias("b"), entry.alias("value"))
    lines = spark.createDataFrame([(0, n, 0, text) for n, text in enumerate(head)], "kind int, a long, b long, value string").unionByName(body)
    lines.orderBy("kind", "a", "b").select("value").write.text(path)
