import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.common import tokenizer_path
from weftgraph.llm.token_counts import count_tokens, tokens_in, word_counts

PATH = tokenizer_path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   ", "a  b", "a\n\n b\t c", "<s> x </s>", "▁a ▁", "é漢字🙂ﬁ　", "a\x00b", "x" * 3000, " lead", "trail ", "\n", "a\n \n b"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeinorst  \n\t▁éü漢🙂<>/0")), max_size=60))
def test_same_as_library(text):
    assert tokens_in(text, *word_counts(PATH)) == len(MODEL.encode(text))


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (99, None, "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(df, limit=2).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(MODEL.encode(t or "")), n > 2) for i, t, _ in rows), key=str)
    assert got == want
    assert count_tokens(df.limit(0)).count() == 0
    long = ["many words of one text " * 20_000, "x" * 30_000, "漢字" * 5000]
    counted = count_tokens(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counted] == [len(MODEL.encode(t)) for t in long]


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(MODEL.encode(r.text)) for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == want
