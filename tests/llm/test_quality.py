import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.common import bytes_of
from weftgraph.llm.quality import base_rules, features, quality_rules

pa = pytest.importorskip("pyarrow")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab é#\n\t|\x0b\x85")), max_size=80)), max_size=6))
def test_rules_by_brute_force(texts):
    got = base_rules(*bytes_of(pa.array(texts, pa.string())))
    assert [tuple(int(c[i]) for c in got.values()) for i in range(len(texts))] == [plain(t) for t in texts]


def test_documents_and_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert {i: tuple(r[1:6]) for i, r in got.items()} == {r.doc_id: plain(r.text) for r in docs.collect()}
    half, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").collect()
    p = {r.doc_id: r.probability for r in quality_rules(docs, half).collect()}
    assert np.mean([(p[r.doc_id] >= 0.3) == (r.quality == 1) for r in rest]) >= 0.9


def test_probabilities_are_calibrated(spark):
    """On labels that training has not seen, the share of good documents is near the probabilities' mean, in all and on either side of one half."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    p = {r.doc_id: r.probability for r in quality_rules(docs, labels.where("doc_id % 3 <> 0")).collect()}
    both = np.array([(p[r.doc_id], r.quality) for r in held.collect()])
    assert len(both) > 1000
    for part in (both, both[both[:, 0] < 0.5], both[both[:, 0] >= 0.5]):
        assert abs(part[:, 0].mean() - part[:, 1].mean()) < 0.05


def test_character_runs(spark):
    """Runs are of three characters, whatever their bytes, and don't cross rows."""
    texts = ["añb", "日本語x", "", "ab", "é🙂z!"]
    both = [features(*bytes_of(pa.array([t], pa.string())))[1] for t in texts]
    assert [len(b) for b, _ in both] == [max(0, len(t) - 2) for t in texts]
    bucket, ends = features(*bytes_of(pa.array(texts, pa.string())))[1]
    assert [bucket[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [b.tolist() for b, _ in both]


def test_edges(spark):
    word = random.Random(1)
    long = " ".join(str(word.random()) for _ in range(100_000))
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, long, 5), (2, long, 5), (3, "a " * 60, 5)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = sorted(quality_rules(docs, labels).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept, r.probability) for r in got] == [(None, 0, True, False, None), (1, 0, True, False, None), (2, 100_000, False, True, None), (2, 100_000, False, True, None), (3, 60, True, False, None)]
    assert quality_rules(docs.limit(0), labels).count() == 0
