import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import vector_graph


def by_brute_force(rows):
    """(n_links, component) of each row."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [j for j in good if j != i and len(rows[j][1]) == len(rows[i][1]) and np.dot(rows[i][1], rows[j][1]) >= 0.95 * np.linalg.norm(rows[i][1]) * np.linalg.norm(rows[j][1])] for i in good}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, ahead = {i}, [i]
        while ahead:
            ahead = [j for a in ahead for j in near.get(a, []) if j not in seen and not seen.add(j)]
        out.append((k, len(near.get(i, [])), min((rows[j][0] for j in seen), default=None) if k is not None else None))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, n_links int")
    got = vector_graph.near_vectors(df, **options).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == by_brute_force(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_clusters_split_shards_and_copies(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(40, 16))
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(np.concatenate([base, base[:1] + 0.05 * draw.normal(size=(150, 16)), base[5:15] + 0.08 * draw.normal(size=(10, 16)), np.repeat(base[:1], 60, 0)]))]
    check(spark, rows)
    check(spark, rows, shard_rows=30, most=40)


def test_group_over_many_shards(spark):
    draw = np.random.default_rng(11)
    hot = draw.normal(size=16)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([draw.normal(size=(200, 16)), hot + 0.12 * draw.normal(size=(400, 16))]))]
    check(spark, rows, shard_rows=30)
    check(spark, rows, shard_rows=30, most=25)


def test_group_is_within_reach():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(1, 64)) + np.where(np.arange(230)[:, None] < 1, 0.001, 0.1) * draw.normal(size=(230, 64)), draw.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vector_graph.pruned_edges(x, 1)
    for start in range(230):
        seen, ahead = {start}, [start]
        while ahead:
            ahead = [k for k in np.unique(b[np.isin(a, ahead)]).tolist() if k < 230 and k not in seen]
            seen |= set(ahead)
        assert len(seen) == 230
    assert np.bincount(a).max() <= vector_graph.MOST_DEGREE


def test_vectors_go_where_links_may_be(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(size=(900, 64)), draw.normal(size=64) + 0.1 * draw.normal(size=(100, 64))])
    groups = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "node long, n long, vec array<double>").cache()
    assert vector_graph.shard(groups, 40, 8, 12_000, 0.95).count() < 1500
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [0.0, 1.0]), (1001, [-0.0, 1.0])]
    check(spark, rows, shard_rows=40)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1e-30, 1e-32])]
    check(spark, rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert vector_graph.near_vectors(df.limit(0)).count() == 0


def test_documents_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert vector_graph.recall(df, vector_graph.near_vectors(df), every=5) >= 0.99


def test_hubs_are_pruned(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([np.ones((1, 16)), draw.normal(size=(1500, 16)) + 1.5])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vector_graph.pruned_edges(x, 1)
    assert np.bincount(a).max() <= vector_graph.MOST_DEGREE and (a != b).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a)


def test_audit(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    df = df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 100_000))
    assert vector_graph.audited(df).count() == df.count()
    monkeypatch.setattr(vector_graph, "near_vectors", lambda rows, **_: rows.selectExpr("vec_id", "0L n_links", "vec_id component_id", "true kept"))
    with pytest.raises(RuntimeError):
        vector_graph.audited(df)
