import duckdb
import pytest

from weftgraph.llm import mixing

D = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = mixing.replicate(docs, mixing.tempered_rates(docs)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    db.execute(mixing.ORACLE_SQL)
    want = db.fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_rates_are_met(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'x' text", "if(id % 4 = 0, 'a', if(id % 4 = 1, 'b', null)) source", "1 copy")
    rates = spark.createDataFrame([("a", 0.3), ("b", 150.0), (None, 2.0), ("c", 1.0)], "source string, rate double")
    rows = {r.source: r for r in mixing.replicate(docs, rates).groupBy("source").agg({"*": "count", "copy": "max"}).collect()}
    for source, n, rate in (("a", 5000, 0.3), ("b", 5000, 150.0), (None, 10_000, 2.0)):
        assert rows[source]["count(1)"] == pytest.approx(n * rate, rel=0.06)
    assert rows["b"]["max(copy)"] < 230


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "a"), (None, "t", "a"), (1, "t", "a"), (1, "t", "a"), (2, "t", "none"), (3, "t", "nul")], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("a", 5.0), ("nul", None), ("none", 0.0)], "source string, rate double")
    rows = mixing.replicate(docs, rates).collect()
    assert {r.source for r in rows} == {"a"}
    ones = sorted(r.copy for r in rows if r.doc_id == 1)
    assert ones[::2] == ones[1::2] and ones
    long = spark.createDataFrame([(1, "w " * 400_000, "a", 1, 2, 3)], "doc_id long, text string, source string, __n int, __key int, __source int")
    made = mixing.replicate(long, rates).collect()
    assert len(made) > 0 and {len(r.text) for r in made} == {800_000} and made[0].asDict().keys() == {*long.columns, "copy", "shuffle_key"}
    assert mixing.replicate(docs.limit(0), rates).count() == 0
    assert mixing.replicate(docs, rates.limit(0)).count() == 0
    assert mixing.tempered_rates(docs.limit(0)).count() == 0
