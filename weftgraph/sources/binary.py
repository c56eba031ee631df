"""Flat binary files: read by range in many tasks, written by the executors in pieces that are then put end to end."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans.lineage import shared_dir

#: Bytes that are read, or copied, at once.
BLOCK_BYTES = 8 << 20


def at_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + path)


def files_of(path: str) -> list[str]:
    """The path itself, or the files of a folder by name."""
    system, at = at_path(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.type == fs.FileType.File and x.base_name[0] not in "._"]


def size_of_file(path: str) -> int:
    system, at = at_path(path)
    return system.get_file_info(at).size


def read_range(path: str, first: int, size: int) -> bytes:
    system, at = at_path(path)
    with system.open_input_file(at) as f:
        return f.read_at(size, first)


def by_ranges(spark: SparkSession, ranges: list[tuple], run: Callable[[tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run() gives for each range (path, first, last, ...), a task for each; only the ranges go through the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from run(ranges[k])

    return spark.range(0, len(ranges), 1, max(1, len(ranges))).mapInArrow(each, schema)


def spans(n: int, most: int) -> list[tuple[int, int]]:
    """[0, n) cut into runs of at most `most`."""
    return [(a, min(a + most, n)) for a in range(0, n, most)]


def write_pieces(ordered: DataFrame, pack: Callable[[pa.RecordBatch], bytes]) -> list[str]:
    """The paths of files, by partition, that hold what pack() makes of each partition's rows in order; in the shared folder.

    A piece is written under a name of its own attempt and renamed, so lost or repeated tasks leave the same pieces.
    """
    spark = ordered.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    system, root = at_path(folder)
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = at_path(folder)
        part = TaskContext.get().partitionId()
        name, attempt = f"{root}/{part:08d}", uuid.uuid4().hex
        with system.open_output_stream(f"{name}.{attempt}") as out:
            for batch in batches:
                out.write(pack(batch))
        system.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"part": [part]})

    made = sorted(r["part"] for r in ordered.mapInArrow(run, "part long").collect())
    return [f"{folder}/{part:08d}" for part in made]


def join_pieces(path: str, header: bytes, pieces: list[str]) -> None:
    """One file of the header and the pieces, copied block by block; the pieces' folders go."""
    system, at = at_path(path)
    with system.open_output_stream(at) as out:
        out.write(header)
        for piece in pieces:
            source, name = at_path(piece)
            with source.open_input_stream(name) as f:
                while block := f.read(BLOCK_BYTES):
                    out.write(block)
    for folder in {p.rsplit("/", 1)[0] for p in pieces}:
        source, name = at_path(folder)
        source.delete_dir(name)


def column(batch: pa.RecordBatch, k: int, dtype: str) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False).astype(dtype)
