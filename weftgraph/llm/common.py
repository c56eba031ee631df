"""What the operators of this package share: the shared folder, size-checked broadcasts, text as bytes in Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut, shared_dir  # noqa: F401

#: Bytes of text handled at once in a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19
#: ASCII white space, the separators of words.
SPACES = b" \t\n\r\x0b\x0c"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_at_exit(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Delete a folder of the shared one, and the table `name` that lies there, when Python ends: results are read from it until then."""

    def run() -> None:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            try:
                if name:
                    spark.sql(f"DROP TABLE IF EXISTS {name}")
                drop(spark, path)
            except Exception:  # the session ended meanwhile; the folder is then left to whoever clears the shared one
                return

    atexit.register(run)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond that from each partition."""
    return df.limit(rows + 1).count() <= rows


def tidy(run: Callable) -> Callable:
    """run, a generator over Arrow batches, giving freed memory back to the system when it ends: workers live on after a task."""

    def wrapped(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())  # others keep freed buffers for later
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column laid end to end, and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of bytes_of() by about `most` bytes: first row, row after the last, bytes, offsets."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_VALUE[list(SPACES)] = 0
_PLACE = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first byte) of each word (run of bytes other than ASCII white space) of the rows of bytes_of(), in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    word = ~_IS_SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = ~word[:-1]
    inner = at[1:-1]
    edge[inner[inner < len(data)]] = True
    starts = np.flatnonzero(word & edge)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    summed = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # by stretches of bytes, as the sums take many times a text's size
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES, "left")))
        lo, hi = starts[first], starts[last] if last < len(starts) else len(data)
        own = starts[first:last] - lo
        run = np.zeros(hi - lo, np.int64)
        run[own] = np.diff(own, prepend=0)
        place = (np.arange(hi - lo) - np.cumsum(run)) & 0xFFFF
        summed[first:last] = np.add.reduceat(_BYTE_VALUE[data[lo:hi]] * _PLACE[place], own)
        first = last
    rows = np.searchsorted(at, starts, "right") - 1
    return rows, mix(summed), starts


def shingles_of(rows: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `size` words in a row; a row with fewer words, but at least one, has one shingle of them all."""
    if not len(rows):
        return rows, words
    weight = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    n = len(rows)
    full = np.zeros(max(0, n - size + 1), bool)
    if n >= size:
        full = rows[: n - size + 1] == rows[size - 1 :]
    summed = np.zeros(len(full), np.uint64)
    for k in range(size):
        summed += words[k : k + len(full)] * weight[k]
    out_rows, out = rows[: len(full)][full], mix(summed[full])
    count = np.bincount(rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            extra[has] += words[first[has] + k] * weight[k]
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, mix(extra ^ np.uint64(0x5851F42D4C957F2D))])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names under others, and what to rename to have them back."""
    held = {c: fresh_name(df, c) for c in df.columns if c in names}
    return df.withColumnsRenamed(held), {v: k for k, v in held.items()}


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file `name` is, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside, and so what a Python worker holds at once, to so many rows; the caller's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"__{name}").lower() in taken:
        pass
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*columns) -> F.Column:
    """A number in [0, 1) drawn from the digits of the MD5 of the columns joined by colons; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
