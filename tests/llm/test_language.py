import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import language, queries

D = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    got = language.identify(docs.where("doc_id % 2 = 1 and n_chars > 50"), half).collect()
    assert sum(r.lang_id == r.lang for r in got) >= 0.97 * len(got)
    whole = language.identify(docs)
    assert whole.where("lang_accepted").count() >= 0.99 * docs.count()
    assert whole.columns == [*docs.columns, "lang_id", "lang_p", "lang_accepted"]


def test_pages(spark):
    pages, docs = spark.read.parquet(f"{D}/pages.parquet"), spark.read.parquet(f"{D}/documents.parquet")
    got = language.identify_pages(pages, docs).join(pages.select("page_id", language.declared_in(F.col("html")).alias("said")), "page_id").collect()
    assert len(got) == pages.count()
    assert sum(r.lang_id == r.said for r in got) >= 0.95 * len(got)


def test_page_query(spark, tmp_path):
    docs = [(i, f"the and of {i}", "en", "s") for i in range(30)] + [(100 + i, f"der und die {i}", "de", "s") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, f"http://h{i}.x.com/", "<html><body>the and of") for i in range(20)] + [(100 + i, f"http://h{i}.y.de/", "<html><body>der und die") for i in range(20)]
    unclear = [(500, "http://a.new.de/", "<html><body>qqq"), (501, "http://a.x.com/", "<html><body>qqq"), (502, "http://b.other.org/", "<html lang=de><body>qqq"), (503, "http://c.other.org/", "<html lang='en-US'><body>qqq"), (504, None, None)]
    spark.createDataFrame(pages + unclear, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.lang_id for r in queries.QUERIES["op10_page_language"](spark, str(tmp_path)).collect()}
    assert got == {**{i: "en" for i in range(20)}, **{100 + i: "de" for i in range(20)}, 500: "de", 501: "en", 502: "de", 503: "en", 504: None}


def plain_runs(text):
    """The buckets of a text's runs of three bytes, one by one."""
    low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in (text or "").encode()]
    out = []
    for x, y, z in zip(low, low[1:], low[2:]):
        if y and (x or z):
            h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(h >> 12 & language.BUCKETS - 1)
    return out


def plain_model(labelled):
    """(languages by rows, log p(bucket | language)) from all labelled rows (text, language)."""
    names = [k for k, _ in sorted(Counter(k for _, k in labelled).items(), key=lambda x: (-x[1], x[0]))]
    total = {k: np.full(language.BUCKETS, 0.05) for k in names}
    for text, k in labelled:
        runs = plain_runs(text)
        for b, n in Counter(runs).items():
            total[k][b] += n / max(1, len(runs)) * min(len(runs), 1000)
    return names, [np.log(total[k] / total[k].sum()) for k in names]


def plain_posteriors(rows, names, logs):
    """(language, posterior) of rows (text, host, suffix, declared), by sums over dictionaries."""
    k, evidence = len(names), []
    for text, *_ in rows:
        runs = plain_runs(text)
        ll = [sum(log[b] for b in runs) / max(1, len(runs)) * min(len(runs), 100) for log in logs]
        evidence.append((len(runs), [x - max(ll) for x in ll]))
    counts = {"host": defaultdict(lambda: [0] * k), "domain": defaultdict(lambda: [0] * k), "suffix": defaultdict(lambda: [0] * k), "all": defaultdict(lambda: [0] * k)}
    domain = lambda h: h.split(".", 1)[1] if "." in h and h.split(".", 1)[1] else "."
    for (_, host, suffix, _), (n, ll) in zip(rows, evidence):
        if n:
            for side, key in (("all", 0), ("host", host), ("domain", host and domain(host)), ("suffix", suffix)):
                if key is not None:
                    counts[side][key][ll.index(max(ll))] += 1
    smooth = lambda c, p: [(x + 20 * q) / (sum(c) + 20) for x, q in zip(c, p)]
    overall, out = smooth(counts["all"][0], [1 / k] * k), []
    for (_, host, suffix, said), (n, ll) in zip(rows, evidence):
        prior = smooth(counts["host"][host], smooth(counts["domain"][domain(host)], overall)) if host in counts["host"] else overall
        score = [a + math.log(p) for a, p in zip(ll, prior)]
        if suffix in counts["suffix"]:
            score = [a + math.log(s / g) for a, s, g in zip(score, smooth(counts["suffix"][suffix], overall), overall)]
        if said in names:
            score = [a + math.log(0.9 if x == said else 0.1 / max(1, k - 1)) for a, x in zip(score, names)]
        best = score.index(max(score))
        out.append((names[best], 1 / sum(math.exp(x - score[best]) for x in score)) if n else (None, None))
    return out


def same(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all((g[1] is None) == (w[1] is None) and (w[1] is None or abs(g[1] - w[1]) < 1e-6) for g, w in zip(got, want))


def test_posteriors_by_brute_force(spark):
    """Documents of many languages with hosts of two levels, and pages with markup, suffixes and hosts, against sums over dictionaries."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    draw = random.Random(8)
    rows = [(r.text, draw.choice(["a.x.com", "b.x.com", "x.com", "c.y.de", None]), r.lang) for r in docs]
    rows += [(f"{chr(97 + i % 26) * 2}{chr(97 + i // 26)}q ww{chr(98 + i % 20)}", f"h{i % 7}.z{i % 3}.org", f"l{i % 70}") for i in range(210)] + [(None, "a.x.com", "en"), ("12", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    names, logs = plain_model([(t, k) for t, _, k in rows if t is not None and k is not None])
    model = language.train(df, 10**6, "doc_id", "text", "lang")
    assert model.languages == names and len(names) >= 70 and np.allclose(model.table.T, logs, atol=1e-4)
    got = [(r.lang_id, r.lang_p) for r in language.identify(df, train_rows=10**6).orderBy("doc_id").collect()]
    assert len({k for k, _ in got}) > 60
    same(got, plain_posteriors([(t, h, None, None) for t, h, _ in rows], names, model.table.T))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    seen = pages.select("page_id", language.text_of(F.col("html")).alias("t"), language.host_of(F.col("url")).alias("h"), language.declared_in(F.col("html")).alias("said")).orderBy("page_id").collect()
    labelled = spark.read.parquet(f"{d}/documents.parquet")
    model = language.train(labelled, language.TRAIN_ROWS, "doc_id", "text", "lang")
    got = [(r.lang_id, r.lang_p) for r in language.identify_pages(pages, labelled).orderBy("page_id").collect()]
    suffix = lambda h: (re.search(r"\.([a-z]+)$", h or "") or [None, None])[1]
    same(got, plain_posteriors([(r.t, r.h, suffix(r.h), r.said) for r in seen], model.languages, model.table.T))


def test_prior_decides_without_text_evidence(spark):
    docs = spark.createDataFrame([(i, "the and of", "en", "a.x.com") for i in range(30)] + [(100 + i, "der und die", "de", "b.y.de") for i in range(30)], "doc_id long, text string, lang string, source string")
    ask = docs.unionByName(spark.createDataFrame([(500, "qqq", None, "a.x.com"), (501, "qqq", None, "new.y.de")], docs.schema))
    got = {r.doc_id: r.lang_id for r in language.identify(ask, docs).where("doc_id >= 500").collect()}
    assert got == {500: "en", 501: "de"}


def test_rare_language_of_a_large_table(spark):
    words = {"en": "the and of which", "de": "der und die nicht"}
    docs = [(i, words[k], k, "s") for i, k in enumerate(["en", "de"] * 6000)]
    rare = [(20_000, "kaj estas la domo", "eo", "s"), (20_001, "quod erat sumus", "la", "s"), (20_002, "kyllä hyvää päivää", "fi", "s"), (20_003, "nem vagyok itthon", "hu", "s")]
    df = spark.createDataFrame(docs + rare, "doc_id long, text string, lang string, source string")
    assert language.identify(df, declared_col="lang").where("doc_id >= 20000 and lang_id = lang").count() == 4
    many = spark.createDataFrame([(i, f"{chr(97 + i // 10) * 3} {chr(97 + i % 10) * 5}", f"l{i}", "s") for i in range(80)], df.schema)
    assert language.identify(many, declared_col="lang").where("lang_id = lang").count() == 80


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "", "en", "s", 1), (2, "the and " * 40_000, "en", None, 1), (2, "the and", "en", "s", 1), (2, "the and", "en", "s", 1), (3, "123 !!", "de", "s", 1)], "doc_id long, text string, lang string, source string, lang_p int")
    got = sorted(((r.doc_id, r.lang_id, r.lang_accepted) for r in language.identify(docs, declared_col="lang").collect()), key=str)
    assert got == sorted([(1, None, False), (None, None, False), (2, "en", True), (2, "en", True), (2, "en", True), (3, None, False)], key=str)
    assert language.identify(docs.limit(0)).count() == 0
    assert language.identify(docs.limit(0), docs).count() == 0
    assert [r.lang_accepted for r in language.identify(docs, docs.limit(0)).collect()] == [False] * 6


def test_addresses(spark):
    urls = ["https://u:p@WWW.Example.co.uk:80/x?y#z", "//h.de/", "nonsense", None]
    df = spark.createDataFrame([(u, h) for u, h in zip(urls, ["<!DOCTYPE html><HTML class=a LANG='fr-CA'>", "<html lang=de>", "<html>", None])], "u string, h string")
    assert [tuple(r) for r in df.select(language.host_of(F.col("u")), language.declared_in(F.col("h"))).collect()] == [("www.example.co.uk", "fr"), ("h.de", "de"), (None, None), (None, None)]
