import hashlib
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_minhash import by_brute_force
from weftgraph.llm.common import tokenizer_path

D = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").cache()
    by_name = dict(corpus_pipeline.STAGES)
    first = by_name["language ID"](spark, docs, D)
    assert first.columns == docs.columns
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in first.collect()} <= lettered and first.count() >= 0.98 * len(lettered)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    second = by_name["MinHash near-dedup"](spark, first, D)
    assert sorted(r.doc_id for r in second.collect()) == sorted({c for _, c, _ in by_brute_force(rows)}) and second.columns == docs.columns
    third = by_name["secret scans"](spark, second, D)
    assert third.columns == docs.columns and third.count() == second.count()
    changed = third.join(second.select("doc_id", second["text"].alias("was")), "doc_id").where("text <> was").collect()
    assert all("[SECRET]" in r.text for r in changed) and changed
    fourth = by_name["mixing sources to target weights"](spark, third, D)
    assert fourth.columns == docs.columns and fourth.exceptAll(third.crossJoin(spark.range(30)).drop("id")).count() == 0
    made = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(ids := made.encode(r.text, add_special_tokens=False).ids), len(ids), hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for r in fourth.collect())
    got = by_name["BPE encoding and decoding"](spark, fourth, D)
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in got.collect()) == want


def test_run(spark):
    got = corpus_pipeline.run(spark, D)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and got.count() > 50


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with the operators' own names."""
    text = "the quick brown fox jumps over the lazy dog and then the fox goes home to the old house"
    long = " ".join(f"word{i}" for i in range(50_000))
    rows = [(i, f"{text} number {i} of many {i * i}", "en", "a", 1) for i in range(30)]
    rows += [(None, text, "en", None, None), (100, None, None, None, None), (101, "", "en", "a", 0), (102, long, "en", "a", 9), (103, text, None, "b", 1), (103, text, None, "b", 1), (104, "12 34", "de", "b", 1)]
    names = ["__key", "__mark", "__e", "__n", "__cdf", "__live", "copy", "shuffle_key", "lang_id", "lang_p", "lang_accepted", "k", "ids", "node"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, *[r[0]] * len(names)) for r in rows], ", ".join([schema, *(f"{n} long" for n in names)]))
    kept = {"language ID": {None, 102, 103, *range(30)}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, D)
        assert made.columns == docs.columns, name
        found = made.collect()
        assert all(r[n] == r.doc_id for r in found for n in names), name
        assert {r.doc_id for r in found} == kept.get(name, {r.doc_id for r in found}), name
        assert name.startswith("mixing") or any(r.doc_id == 102 and r.text == long for r in found), name
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, D).collect()
    assert len(encoded) == len(rows) and {r.doc_id: r.n_tokens for r in encoded}[100] == 0
    one = corpus_pipeline.STAGES[1][1](spark, docs, D).collect()
    assert sum(r.doc_id == 103 for r in one) == 1 and {100, 101, None} <= {r.doc_id for r in one}


def test_heaps_are_given_back_between_stages(spark):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "Mark" in b.getName())

    docs = spark.createDataFrame([(1, "some words", "src")], "doc_id long, text string, source string")
    for stage in (corpus_pipeline.secret_scan, corpus_pipeline.bpe):
        before = collections()
        stage(spark, docs, "")
        assert collections() > before
