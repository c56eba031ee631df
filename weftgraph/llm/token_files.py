"""Token ids as flat files of unsigned integers with 64-bit document offsets (operator 8).

A folder holds, for each part p: ids-p.bin (ids end to end, little-endian unsigned, 16 bits where the vocabulary allows,
else 32), ids-p.idx (n + 1 64-bit offsets into the part) and ids-p.doc (n 64-bit document ids; those of the part's first
`nulls` documents are null and hold 0), and one manifest.json with the width and each part's counts and base. A
document's place in the whole is its part's base plus its offset.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows, shared_dir, tokenizer_path
from weftgraph.llm.word_table import _SYMBOLS, tokenizer
from weftgraph.sources.binary import at_path

#: Distinct words whose ids a worker keeps before it starts afresh, and characters of a word that is kept, which together bound its memory.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64
#: Bytes of text of a part, about; there are at least as many parts as shuffle partitions.
PART_BYTES = 256 << 20
#: Documents, and bytes of ids, in an Arrow batch that reading gives; a longer document is read alone.
READ_ROWS, READ_BYTES = 4096, 8 << 20


class Mapped:
    """A file's integers by range: memory-mapped where it is local, else read range by range."""

    def __init__(self, path: str, dtype: str):
        system, at = at_path(path)
        self.dtype, self.file, self.flat = np.dtype(dtype), None, None
        if isinstance(system, fs.LocalFileSystem):
            self.flat = np.memmap(at, dtype, "r") if system.get_file_info(at).size else np.zeros(0, dtype)
        else:
            self.file = system.open_input_file(at)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.flat is not None:
            return self.flat[span]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, span.stop - span.start) * width, span.start * width), self.dtype)


class WordIds(dict):
    """Packed ids of each lower-case word met; encoded by the library's model on first sight."""

    def __init__(self, model, dtype: str):
        super().__init__()
        self.model, self.kind = model, "H" if dtype == "<u2" else "I"

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(_SYMBOLS)
        ids = array(self.kind, [t.id for t in self.model.tokenize(symbols)]).tobytes()
        if len(word) <= KEPT_LENGTH:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_splitter(path: str) -> tuple[re.Pattern, re.Pattern] | None:
    """(words, what must not occur) for texts of Latin letters, if the tokenizer lower-cases and splits as this file knows; else None.

    Below U+0250 lower case goes by single characters, nothing decomposes, and the classes of characters can be listed.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    if steps != ["NFC", "Replace", "Lowercase"] or (split.get("pattern") or {}).get("Regex") != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        return None
    known = [chr(c) for c in [*range(9, 14), *range(32, 127), 0x85, *range(0xA0, 0x250)]]
    letters = re.escape("".join(c for c in known if unicodedata.category(c)[0] == "L"))
    numbers = re.escape("".join(c for c in known if unicodedata.category(c)[0] == "N"))
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
    return (
        re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"),
        re.compile(f"[^{re.escape(''.join(c for c in known if c != chr(0x130)))}]" + (f"|{special}" if special else "")),
    )


def encoder(path: str, dtype: str):
    """text -> packed ids, equal to the library's; texts that the fast splitter doesn't know go to the library."""
    made, patterns = tokenizer(path), word_splitter(path)
    words = WordIds(made.model, dtype)

    def encode(text: str) -> bytes:
        if patterns and not patterns[1].search(text):
            return b"".join(map(words.__getitem__, patterns[0].findall(text.lower())))
        return np.array(made.encode(text, add_special_tokens=False).ids, dtype).tobytes()

    return encode


def write_token_files(df: DataFrame, path: str, name: str = "word_bpe_49k.json", end_id: int = 1, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the ids of each row's whole text, then end_id, in ascending order of id; returns the manifest's parts.

    Rows are dealt out by ranges of (id, hash of the text), so that repeated ids are split too, and sorted in each part.
    A part is written under another name and renamed, so a lost or repeated task leaves the same files. Bases are prefix
    sums of the parts' counts. parts: unless given, one for each PART_BYTES of text, spark.sql.shuffle.partitions at least.

    Null ids come first, null and empty texts have end_id alone, repeated rows are written each, an empty table gives
    empty files, other columns are left out.
    """
    spark = df.sparkSession
    if not parts:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dtype = "<u2" if max(tokenizer(tokenizer_path(name)).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    system, root = at_path(path)
    system.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = at_path(path)
        encode, end = encoder(tokenizer_path(name), dtype), np.array([end_id], dtype).tobytes()
        context = TaskContext.get()
        part, attempt = context.partitionId(), uuid.uuid4().hex
        name_of = lambda kind: f"{root}/ids-{part:06d}.{kind}"
        lengths, ids, nulls = [], [], 0
        with system.open_output_stream(f"{name_of('bin')}.{attempt}") as out:
            for batch in batches:
                for text in batch.column(1):
                    packed = encode(text.as_py() or "") + end
                    out.write(packed)
                    lengths.append(len(packed) // int(dtype[-1]))
                nulls += batch.column(0).null_count
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        for kind, values in (("idx", offsets), ("doc", np.concatenate([*ids, np.zeros(0, "<i8")]))):
            with system.open_output_stream(f"{name_of(kind)}.{attempt}") as out:
                out.write(values.tobytes())
        for kind in ("bin", "idx", "doc"):
            system.move(f"{name_of(kind)}.{attempt}", name_of(kind))
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(lengths)], "tokens": [int(offsets[-1])], "nulls": [nulls]})

    rows = df.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, F.col("k"), F.xxhash64("text")).sortWithinPartitions("k", F.xxhash64("text"))
    with arrow_rows(spark, 2000):
        made = sorted(ranged.mapInArrow(run, "part long, docs long, tokens long, nulls long").toArrow().to_pylist(), key=lambda r: r["part"])
    base = 0
    for row in made:
        row["base"], base = base, base + row["tokens"]
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "parts": made}).encode())
    return made


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (32-bit unsigned, little-endian, packed) of each document in a folder."""
    system, root = at_path(path)
    with system.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.readall())
    parts, dtype = [r for r in manifest["parts"] if r["docs"]], manifest["dtype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                row = parts[k]
                at = f"{path}/ids-{row['part']:06d}"
                ids, offsets, docs = Mapped(f"{at}.bin", dtype), Mapped(f"{at}.idx", "<i8"), Mapped(f"{at}.doc", "<i8")
                i = 0
                while i < row["docs"]:
                    own = np.array(offsets[i : min(i + READ_ROWS, row["docs"]) + 1])
                    own = own[: max(2, int(np.searchsorted(own, own[0] + READ_BYTES // 4, "right")))]
                    n, held = len(own) - 1, ids[int(own[0]) : int(own[-1])].astype("<u4")
                    packed = [held[a:b].tobytes() for a, b in zip(own[:-1] - own[0], own[1:] - own[0], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(docs[i : i + n]), mask=np.arange(i, i + n) < row["nulls"]), pa.array(own[:-1] + row["base"]), pa.array(np.diff(own)), pa.array(packed, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    i += n

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def drop_token_files(path: str) -> None:
    """Delete a folder of token files, if it is there."""
    system, root = at_path(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)
