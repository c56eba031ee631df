"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join (operator 4)."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows, bytes_of, drop_at_exit, give_back, shared_dir, tidy, tokenizer_path

#: Words of a chunk of documents, and their bytes, after which another chunk begins.
CHUNK_WORDS, CHUNK_BYTES = 2_000_000, 16 << 20
#: Documents of a chunk in one row of the coded documents, and lists that are decoded at once.
ROW_DOCUMENTS = 500
#: Buckets of the distinct-word table for each shuffle partition, and buckets at most.
BUCKETS_EACH, MOST_BUCKETS = 2, 4096
#: Kinds of rows of the coded documents: words, whole texts that only the library can split, documents.
WORD, WHOLE, DOCUMENT = 0, 1, 2
_CODED = "chunk long, kind int, seq int, ks array<long>, lens array<int>, data binary"
# The byte-level pre-tokenizer's pattern, white space as Unicode has it.
WORD_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


def byte_symbols() -> dict[int, str]:
    """The printable symbol that stands for each byte in a byte-level vocabulary, as a table for str.translate()."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_SYMBOLS = byte_symbols()


def pieces(path: str) -> dict[int, bytes]:
    """The bytes of each id's piece."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in _SYMBOLS.items()}
    added = {x["id"]: x["content"] for x in spec["added_tokens"]}
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | added
    return {i: bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for i, p in by_id.items()}


def odd_pattern(path: str) -> str:
    """Matches texts that the pattern of words can't split: special strings inside, or characters newer than the JVM's Unicode."""
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    return "|".join([*("\\Q" + s + "\\E" for s in special), r"\p{Cn}", r"\p{Co}"])


def split_words(df: DataFrame, path: str) -> DataFrame:
    """k, words, odd: the words of each text, or the text itself where only the library can split it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = text.rlike(odd_pattern(path))
    return df.select("k", F.when(~odd, F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))).alias("words"), F.when(odd, text).alias("odd"))


def packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of 32-bit integers, laid out by byte planes, and bytes, as one compressed block."""
    flat = [p if isinstance(p, bytes) else np.ascontiguousarray(p.astype("<u4").view("u1").reshape(-1, 4).T).tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(p) for p in flat], "<u8").tobytes() + b"".join(flat))


def unpacked(block: bytes, kinds: str) -> list:
    """The parts of packed(): i for integers, b for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, "<u8", len(kinds)).tolist(), strict=True):
        part = raw[at : at + size]
        out.append(part if kind == "b" else np.ascontiguousarray(np.frombuffer(part, "u1").reshape(4, -1).T).view("<u4").ravel())
        at += size
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["chunk", "kind", "seq", "ks", "lens", "data"])


def word_rows(chunk: int, kind: int, words: pa.Array, codes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A row for each bucket of a chunk's distinct words: their codes, lengths and bytes, by word."""
    bucket = np.array([zlib.crc32(w) % buckets for w in words.cast(pa.binary()).to_pylist()], np.int64)
    order = pc.sort_indices(pa.table({"b": bucket, "w": words}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
    data, at = bytes_of(words.take(pa.array(order)))
    bucket, codes = bucket[order], codes[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield chunk, kind, int(bucket[lo]), None, None, packed(codes[lo:hi], np.diff(at[lo : hi + 1]), data[at[lo] : at[hi]].tobytes())


def chunk_rows(chunk: int, batches: list[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    """The rows of a chunk of split documents (k, words without null lists, odd): see _CODED. Codes count from the most frequent word. Empties `batches`, as a chunk's words take much memory."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    batches.clear()
    k, listed, odd = (c.chunk(0) for c in rows.columns)
    at = listed.offsets.to_numpy().astype(np.int64)
    met, whole = listed.values.slice(at[0], at[-1] - at[0]).dictionary_encode(), odd.drop_null().dictionary_encode()
    del rows, listed
    code, lens, at = met.indices.to_numpy(), np.diff(at), at - at[0]
    if len(whole):
        lone = np.flatnonzero(odd.is_valid().to_numpy(zero_copy_only=False))
        code = np.insert(code, at[lone], whole.indices.to_numpy() + len(met.dictionary))
        lens[lone] = 1
        at = np.concatenate([[0], np.cumsum(lens)])
    total = len(met.dictionary) + len(whole.dictionary)
    rank = np.empty(total, np.int32)
    rank[np.argsort(-np.bincount(code, minlength=total), kind="stable")] = np.arange(total)
    code = rank[code] if total else code
    for i in range(0, len(k), ROW_DOCUMENTS):
        j = min(i + ROW_DOCUMENTS, len(k))
        yield chunk, DOCUMENT, i // ROW_DOCUMENTS, k.slice(i, j - i).to_pylist(), lens[i:j], packed(code[at[i] : at[j]])
    yield from word_rows(chunk, WORD, met.dictionary, rank[: len(met.dictionary)], buckets)
    yield from word_rows(chunk, WHOLE, whole.dictionary, rank[len(met.dictionary) :], buckets)


def coded(split: DataFrame, buckets: int) -> DataFrame:
    """Documents as codes of their words, and the words that the codes stand for, by chunk; see _CODED.

    A chunk is a run of a partition's documents with about CHUNK_WORDS words or CHUNK_BYTES of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, words, size = TaskContext.get().partitionId() << 20, [], 0, 0
        for whole in batches:
            for i in range(0, len(whole), ROW_DOCUMENTS):
                batch = whole.slice(i, ROW_DOCUMENTS)
                listed = batch.column(1).fill_null([])
                held.append(pa.RecordBatch.from_arrays([batch.column(0), listed, batch.column(2)], ["k", "words", "odd"]))
                words += listed.offsets[-1].as_py() - listed.offsets[0].as_py()
                size += sum(pc.sum(pc.binary_length(x)).as_py() or 0 for x in (listed.flatten(), batch.column(2)))
                if words >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    for row in chunk_rows(chunk, held, buckets):
                        yield _batch([row])
                    chunk, words, size = chunk + 1, 0, 0
        if held:
            for row in chunk_rows(chunk, held, buckets):
                yield _batch([row])

    return split.mapInArrow(tidy(run), _CODED)


def encode_words(words: list[str], model) -> list[bytes]:
    """Ids of each word by the library's byte-pair model, as 32-bit integers."""
    return [np.array([t.id for t in model.tokenize(w.encode().decode("latin-1").translate(_SYMBOLS))], "<i4").tobytes() for w in words]


def word_ids(words: DataFrame, name: str) -> DataFrame:
    """The ids of each chunk's words, by code: the distinct-word table, a bucket of it at a time.

    All chunks' rows of a bucket meet in one task, one after the other, so each distinct word is encoded once for the
    whole corpus; a bucket's words and ids are held until the next one begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, table, at = tokenizer(tokenizer_path(name)), {}, None
        for batch in batches:
            for chunk, kind, bucket, block in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5)), strict=True):
                if at != (kind, bucket):
                    at, table = (kind, bucket), {}
                codes, lens, text = unpacked(block, "iib")
                ends = np.cumsum(lens).tolist()
                found = []
                for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                    word = text[lo:hi]
                    ids = table.get(word)
                    if ids is None:
                        ids = encode_words([word.decode()], made.model)[0] if kind == WORD else np.array(made.encode(word.decode(), add_special_tokens=False).ids, "<i4").tobytes()
                        table[word] = ids
                    found.append(ids)
                yield _batch([(chunk, WORD, bucket, None, None, packed(codes, np.array([len(x) // 4 for x in found]), np.frombuffer(b"".join(found), "<i4")))])

    return words.repartition("kind", "seq").sortWithinPartitions("kind", "seq", "chunk").mapInArrow(tidy(run), _CODED)


def positioned(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, ids: each chunk's documents, their codes replaced by the ids of the words they stand for."""

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        give_back()  # what the chunk before took
        blocks = [unpacked(b.as_py(), "iii") for b in words["data"]]
        codes, lens, flat = (np.concatenate([np.zeros(0, "<u4"), *(b[c] for b in blocks)]) for c in range(3))
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat.view("<i4"))).take(pa.array(np.argsort(codes)))
        del blocks, codes, lens, flat, ends
        out = []
        for ks, counts, block in zip(*(documents.sort_by("seq")[c] for c in ("ks", "lens", "data")), strict=True):
            found = lists.take(pa.array(unpacked(block.as_py(), "i")[0]))
            at = found.offsets.to_numpy()[np.concatenate([[0], np.cumsum(counts.values.to_numpy(), dtype=np.int64)])]
            out.append(pa.RecordBatch.from_arrays([ks.values, pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), found.values.slice(at[0], at[-1] - at[0]))], ["doc_id", "ids"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return documents.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(run, "doc_id long, ids array<int>")


def encode(df: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text, as the tokenizers library encodes it without added special tokens.

    Spark splits the texts into words. Each task writes its documents as codes and, once for each chunk of documents, the
    distinct words that the codes stand for, to a table in the shared folder that is bucketed by chunk (dropped at
    exit). The words meet by bucket of their hash, where each distinct word is encoded once for the whole corpus; its ids
    go back to the chunks, where codes are replaced by position. So words move once for each chunk that has them, and
    neither texts nor codes move. Texts with special strings or characters that the JVM's Unicode tables don't know are
    taken as one word each, which the library encodes.

    One row for each input row: null ids stay null, null and empty texts have no ids, repeated rows stay, very long texts
    stay whole, an empty table gives none, other columns, whatever their names, are left out.
    """
    spark, path = df.sparkSession, tokenizer_path(name)
    split = split_words(df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")), path)
    parts, name_of = int(spark.conf.get("spark.sql.shuffle.partitions")), f"coded_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{name_of}"
    drop_at_exit(spark, folder, name_of)
    written = coded(split, min(BUCKETS_EACH * parts, MOST_BUCKETS)).write.format("parquet").option("compression", "zstd").option("path", folder)
    with arrow_rows(spark, 1000):
        written.bucketBy(parts, "chunk").saveAsTable(name_of)
    rows = spark.table(name_of)
    return positioned(rows.where(F.col("kind") == DOCUMENT).select("chunk", "seq", "ks", "lens", "data"), word_ids(rows.where(F.col("kind") < DOCUMENT), name).select("chunk", "data"))


def texts_of(ids: pa.Array, table: pa.Table) -> list[str]:
    """The text of each list of ids: an outer join of the ids with the pieces by hash, in order, and their bytes end to end."""
    ids = ids.fill_null([])
    at = ids.offsets.to_numpy().astype(np.int64)
    tokens = ids.values.slice(at[0], at[-1] - at[0])
    data, ends = bytes_of(table["piece"].take(pc.index_in(tokens, value_set=table["id"])).combine_chunks())
    ends, data = ends[at - at[0]].tolist(), memoryview(data)
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(df: DataFrame, name: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text: every id is joined with the table of pieces, whose bytes are put end to end; what isn't UTF-8 is replaced.

    The table has a row for each id of the vocabulary, so each worker holds it; the join goes by hash over the ids of
    ROW_DOCUMENTS lists at a time and keeps their order, so nothing is shuffled.

    One row for each input row. Null ids inside a list and ids outside the vocabulary have no piece; a null or empty list
    decodes to an empty text; null doc_ids and repeated rows stay; very long lists stay whole; an empty table gives none;
    other columns, whatever their names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pieces(tokenizer_path(name))
        table = pa.table({"id": pa.array(list(by_id), pa.int32()), "piece": pa.array(list(by_id.values()), pa.large_binary())}).combine_chunks()
        for whole in batches:
            for i in range(0, len(whole), ROW_DOCUMENTS):
                batch = whole.slice(i, ROW_DOCUMENTS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts_of(batch.column(1), table), pa.string())], ["doc_id", "ids", "text"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, text string")
