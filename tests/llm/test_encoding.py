import numpy as np
from tokenizers import Tokenizer

from weftgraph.llm import word_table
from weftgraph.llm.common import tokenizer_path
from weftgraph.llm.token_files import drop_token_files, new_folder, read_token_files, write_token_files
from weftgraph.llm.word_table import decode, encode

TEXTS = [
    "", " ", "  \n\t x  y ", "Don't WE'LL it's I'M", "<|endoftext|> a<|endoftext|>", "x!!<|startoftext|>!", "é漢字🙂ﬁ　ＡＢ", "a\x00b\x1cc\x7f", "İstanbul ΣΑΣ ß", "é café",
    "1234½²³ ªº", "\xa0\x85 a b", "a" * 20_000, "ab \n" * 5_000, " private", "ǅ Ǆ ŉ", "ᷰ0", "’s ‘t", "tail ", "\U0001f9ff\U0001fae0", " \r\n",
]


def rows(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "null id", 0), (500, None, 0), (3, "Again", 1)], "doc_id long, text string, ids int")


def test_word_table_same_as_library(spark):
    made = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for df in (rows(spark), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = sorted(((r.doc_id, list(r.ids), r.text) for r in decode(encode(df)).collect()), key=str)
        want = [(r.doc_id, made.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()]
        assert got == sorted(((k, ids, made.decode(ids, skip_special_tokens=False)) for k, ids in want), key=str)
    assert decode(encode(rows(spark).limit(0))).count() == 0
    assert [r.text for r in decode(spark.createDataFrame([(1, None), (2, [30325])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()] == ["", made.decode([30325])]
    odd = spark.createDataFrame([(1, [30325, None, 10_000_000, 30325], 0), (1, [], 1), (None, [100, 101], 2)], "doc_id long, ids array<int>, pos int")
    assert sorted(map(str, (r.text for r in decode(odd).collect()))) == sorted(["", made.decode([30325, 30325]), made.decode([100, 101])])


def test_words_are_encoded_once_whatever_the_chunks(spark, monkeypatch):
    """Small chunks and slices, so that words are shared by many chunks; the ids don't change, and no word has two rows in the table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r.doc_id, list(r.ids)) for r in encode(docs).collect())
    monkeypatch.setattr(word_table, "CHUNK_WORDS", 500)
    monkeypatch.setattr(word_table, "ROW_DOCUMENTS", 7)
    assert sorted((r.doc_id, list(r.ids)) for r in encode(docs.repartition(3)).collect()) == want
    split = word_table.split_words(docs.selectExpr("doc_id k", "text"), tokenizer_path("byte_bpe_50k.json"))
    words = [(r.kind, r.seq) for r in word_table.coded(split, 16).where("kind < 2").collect()]
    assert len(words) > len(set(words))


def test_token_files_same_as_library(spark):
    made = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for df, parts in ((rows(spark), 3), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), None)):
        path = new_folder(spark)
        manifest = write_token_files(df, path, parts=parts)
        got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda k: (k is not None, k))
        want = sorted(((r.doc_id, [*made.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.collect()), key=str)
        assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=str) == want
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
        assert sum(p["tokens"] for p in manifest) == sum(len(ids) for _, ids in want)
    path = new_folder(spark)
    write_token_files(rows(spark).limit(0), path)
    assert read_token_files(spark, path).count() == 0
    drop_token_files(path)
    drop_token_files(path)
