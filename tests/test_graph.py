"""Hand-worked values on a small graph, sources and sinks, samplers and training."""

import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.config import EmbedConfig, epoch_distribution, parameter_grid, parse_args
from weftgraph.functions import scalars as sc
from weftgraph.operators import bloom, coarsen, components, graph, matrix, order, sampling, train
from weftgraph.operators.components import connected_components
from weftgraph.plans.ranking import balanced_part, global_rank, sums_before
from weftgraph.sources import edges as ed
from weftgraph.sources import matrix_market as mm
from weftgraph.sources import vectors as ve
from weftgraph.streaming.edges import windowed_degrees

TINY = [(0, 3), (1, 4), (0, 5), (3, 5), (0, 2), (4, 5), (2, 3), (5, 6), (2, 4), (1, 2)]


@pytest.fixture(scope="module")
def tiny(spark):
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(TINY)], "src long, dst long, line long").cache()
    arcs = graph.symmetrize(edges)
    degree = graph.degrees(graph.vertices(edges), arcs).cache()
    return edges, arcs, degree, graph.slots(arcs, "line", "side").cache()


def lists(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_structure(tiny):
    edges, arcs, degree, placed = tiny
    assert graph.size_of(edges) == (7, 10)
    assert [r.off for r in graph.offsets(degree).orderBy("id").collect()] == [0, 3, 5, 9, 12, 15, 19]
    near = {r.id: list(r.nbrs) for r in graph.packed(placed).collect()}
    assert near == {0: [3, 5, 2], 1: [4, 2], 2: [0, 3, 4, 1], 3: [0, 5, 2], 4: [1, 5, 2], 5: [0, 3, 4, 6], 6: [5]}
    assert [r.id for r in graph.visit_order(degree).orderBy("rank").collect()] == [5, 2, 4, 3, 0, 1, 6]
    assert lists(graph.eligible(degree), "id") == [(1,), (6,)]
    assert graph.bandwidth(edges).first()[0] == 5 and tuple(graph.density(degree).first()) == (7, 20, 2)
    assert graph.two_hop(arcs).count() == 64 == graph.two_hop_counts(arcs, degree).agg(F.sum("paths")).first()[0]
    want = {(0, 3): (2, 4), (1, 4): (1, 4), (0, 5): (1, 6), (3, 5): (1, 6), (0, 2): (1, 6), (2, 3): (1, 6), (2, 4): (1, 6), (1, 2): (1, 5), (4, 5): (0, 7), (5, 6): (0, 5)}
    assert {(r.src, r.dst): (r.common, r.joint) for r in graph.jaccard(graph.simple(edges)).collect()} == want


def test_signatures(tiny):
    edges, arcs, _, _ = tiny
    want = {0: {19, 42, 46, 63, 88, 100}, 1: {9, 19, 63, 65}, 6: {46, 88}, 5: {9, 42, 65, 83, 100, 101, 111, 117}}
    got = {}
    for r in bloom.bits(arcs).collect():
        got.setdefault(r.id, set()).add(r.bit)
    assert all(got[k] == v for k, v in want.items())
    scored = {(r.src, r.dst): (r.c, r.den) for r in bloom.approximate_jaccard(edges, bloom.signatures(arcs)).collect()}
    assert scored[0, 3] == (2, 10) and scored[1, 4] == (1, 9) and scored[4, 5] == (0, 14) and scored[5, 6] == (0, 10)


def test_cuts_and_orders(tiny, spark):
    edges, _, _, _ = tiny
    ids = spark.range(7).select("id", F.col("id").alias("rank"))
    assert [order.cut_of(edges, order.partition(ids, n)).first()[0] for n in (2, 3, 4)] == [4, 7, 8]
    emb = spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(7)], "id long, vec array<double>")
    assert [r.id for r in order.by_coordinate(emb).orderBy("rank").collect()] == [2, 5, 1, 4, 0, 3, 6]
    assert order.edge_distances(edges, emb).where("src = 0 and dst = 5").first()["dist"] == 7.0
    assert sorted(r["rank"] for r in order.reverse_cuthill_mckee(edges).collect()) == list(range(7))
    path = spark.createDataFrame([(3, 9), (9, 1), (1, 7), (7, 5)], "src long, dst long")
    rank = {r.id: r["rank"] for r in order.reverse_cuthill_mckee(path).collect()}
    assert graph.bandwidth(order.relabel(path, order.reverse_cuthill_mckee(path))).first()[0] == 1 and len(rank) == 5
    # many components, a vertex with a loop only, a long path: every vertex has a rank, components are runs of ranks
    many = [(10 * k, 10 * k + 1) for k in range(30)] + [(500, 500)] + [(600 + k, 601 + k) for k in range(13)] + [(600, 601)]
    rank = {r.id: r["rank"] for r in order.reverse_cuthill_mckee(spark.createDataFrame(many, "src long, dst long")).collect()}
    assert sorted(rank.values()) == list(range(60 + 1 + 14)) and set(rank) == {x for e in many for x in e}
    assert rank[500] == 74 and all(abs(rank[a] - rank[b]) <= 1 for a, b in many)
    assert [tuple(r) for r in order.pair_lattice(spark, 3).orderBy("pair").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 2, 1), (5, 2, 2)]


def plain_rcm(pairs):
    """id -> rank by a queue, one component after the other."""
    near = {x: set() for p in pairs for x in p}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    key, out = lambda v: (len(near[v]), v), []
    for start in sorted(near, key=key):
        if start in out:
            continue
        level = [start]
        while level:
            out += level
            via = {}
            for k, v in enumerate(level):
                for u in near[v]:
                    if u not in out:
                        via.setdefault(u, k)
            level = sorted(via, key=lambda u: (via[u], *key(u)))
    return {v: len(out) - 1 - k for k, v in enumerate(out)}


def test_reverse_cuthill_mckee_by_brute_force(spark):
    draw = random.Random(6)
    pairs = [(draw.randrange(80), draw.randrange(80)) for _ in range(70)]
    got = {r.id: r["rank"] for r in order.reverse_cuthill_mckee(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == plain_rcm(pairs)


def fill_in(pairs, rank):
    """Entries that elimination in an order adds."""
    near = {v: set() for v in rank}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    added = 0
    for v in sorted(rank, key=rank.get):
        later = {u for u in near[v] if rank[u] > rank[v]}
        for u in later:
            added += len(later - near[u] - {u})
            near[u] |= later - {u}
    return added // 2


def test_minimum_degree_and_pictures(spark):
    grid = [(10 * i + j, 10 * (i + k) + j + 1 - k) for i in range(10) for j in range(10) for k in (0, 1) if i + k < 10 and j + 1 - k < 10]
    edges = spark.createDataFrame(grid, "src long, dst long")
    rank = {r.id: r["rank"] for r in order.minimum_degree(edges).collect()}
    assert sorted(rank.values()) == list(range(100))
    assert fill_in(grid, rank) < 0.6 * fill_in(grid, {v: v for v in range(100)})
    star = spark.createDataFrame([(5, k) for k in (0, 1, 2, 3)], "src long, dst long")
    assert [r.id for r in order.minimum_degree(star).orderBy("rank").collect()][:3] == [0, 1, 2]
    by_id = spark.range(100).select("id", F.col("id").alias("rank"))
    made = matrix.spy_orders(edges, {"id": by_id, "rcm": order.reverse_cuthill_mckee(edges), "degree": order.minimum_degree(edges)}, 5, 100).collect()
    assert {r.ordering for r in made} == {"id", "rcm", "degree"}
    assert all(sum(r.n for r in made if r.ordering == o) == 2 * len(grid) for o in ("id", "rcm", "degree"))
    assert all(abs(r.row - r.col) <= 1 for r in made if r.ordering != "degree")


def test_coarsening(tiny, spark):
    _, arcs, degree, placed = tiny
    for cap, want, task in ((0, [4, 5, 1, 3, 2, 0, 6], 0), (1, [4, 1, 1, 3, 2, 0, 0], 0), (1, [4, 1, 1, 3, 2, 0, 0], 100)):
        cmap = coarsen.cluster_ids(coarsen.match(placed, degree, cap, task), degree)
        assert [r.super for r in cmap.orderBy("id").collect()] == want
    cmap = coarsen.cluster_ids(coarsen.match(placed, degree), degree)
    assert [r.super for r in cmap.orderBy("id").collect()] == [4, 1, 1, 3, 2, 0, 0]
    coarse = coarsen.contract(arcs, cmap)
    near = {}
    for r in coarse.collect():
        near.setdefault(r.src, set()).add(r.dst)
    assert near == {0: {4, 3, 2}, 1: {4, 3, 2}, 2: {1, 0}, 3: {4, 0, 1}, 4: {3, 0, 1}}
    assert [x["n"] for x in coarsen.levels(arcs, EmbedConfig())] == [7]


def sequential_matching(placed, degree, cap):
    """id -> hub by the rule, one vertex after the other."""
    deg = {r.id: r.deg for r in degree.collect()}
    near = {}
    for r in sorted(placed.collect(), key=lambda r: r.pos):
        near.setdefault(r.src, []).append(r.dst)
    limit, hub = sum(deg.values()) // len(deg) + 1, {}
    for i in sorted((i for i, d in deg.items() if d > 0), key=lambda i: (-deg[i], -i)):
        if i in hub:
            continue
        hub[i], took = i, 0
        for j in near.get(i, []):
            if took < cap and j not in hub and 0 < deg[j] < limit:
                hub[j], took = i, took + 1
    return sorted(hub.items())


def test_matching_by_rounds_is_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(coarsen, "_SLOTS", 2)
    draw = random.Random(2)
    for hubs, ways in ((False, ((None, 0),)), (True, ((2, 0), (2, 30), (1, 10**6)))):
        n = draw.randrange(20, 60)
        pick = lambda: draw.randrange(n) if not hubs or draw.random() < 0.6 else draw.randrange(3)
        edges = spark.createDataFrame([(pick(), draw.randrange(n)) for _ in range(draw.randrange(n, 3 * n))], "src long, dst long")
        arcs = graph.symmetrize(ed.with_lines(edges)).cache()
        degree, placed = graph.degrees(graph.vertices(edges), arcs).cache(), graph.slots(arcs, "line", "side").cache()
        for cap, task in ways:
            assert lists(coarsen.match(placed, degree, cap, task), "id", "hub") == sequential_matching(placed, degree, cap or 10**9)


def test_capped_matching_of_hubs_that_compete_takes_few_passes(spark, monkeypatch):
    """28 hubs have the same 30 neighbours, or most of them, and each takes two: one after the other, by rounds."""
    monkeypatch.setattr(coarsen, "_WINDOW", 8)
    monkeypatch.setattr(coarsen, "_BLOCK", 100)
    made, cut = [], coarsen.cut
    monkeypatch.setattr(coarsen, "cut", lambda df: made.append(1) or cut(df))
    draw = random.Random(5)
    edges = spark.createDataFrame([(40 + h, v) for h in range(28) for v in range(30) if draw.random() < 0.9] + [(a, a + 1) for a in range(70, 100)], "src long, dst long")
    arcs = graph.symmetrize(edges).withColumn("pos", F.col("dst")).cache()
    degree = graph.degrees(graph.vertices(edges), arcs).cache()
    assert lists(coarsen.match(arcs, degree, 2, 0), "id", "hub") == sequential_matching(arcs, degree, 2)
    assert len(made) < 25


def test_capped_matching_in_blocks_is_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(coarsen, "_WINDOW", 2)
    monkeypatch.setattr(coarsen, "_WIDEST", 4)
    monkeypatch.setattr(coarsen, "_BLOCK", 12)
    draw = random.Random(7)
    path = [(a, a + 1) for a in range(30)]
    wild = [(draw.randrange(3) if draw.random() < 0.4 else draw.randrange(40), draw.randrange(40)) for _ in range(90)]
    for pairs, cap in ((path, 1), (wild, 1), (wild, 3)):
        edges = spark.createDataFrame(pairs, "src long, dst long")
        arcs = graph.symmetrize(ed.with_lines(edges)).cache()
        degree, placed = graph.degrees(graph.vertices(edges), arcs).cache(), graph.slots(arcs, "line", "side").cache()
        assert lists(coarsen.match(placed, degree, cap, 0), "id", "hub") == sequential_matching(placed, degree, cap)


def test_alias(tiny):
    _, _, degree, _ = tiny
    for weighted, percent in ((degree.select("id", F.col("deg").alias("w")), [75, 70, 75, 80, 80, 100, 35]), (degree.select("id", F.pow("deg", F.lit(0.75)).alias("w")), [82, 77, 76, 87, 81, 100, 46])):
        rows = sampling.alias_table(weighted).orderBy("id").collect()
        assert [r.percent for r in rows] == percent and [r.other for r in rows][:6] == [3, 0, 4, 5, 5, 5] and rows[6].other == 2
    rows = sampling.alias_table(degree.select("id", F.col("deg").alias("w")), stacks=True).collect()
    kept = {r.id: 0.0 for r in rows}
    for r in rows:
        kept[r.id] += r.percent / 700
        kept[r.other] += (100 - r.percent) / 700
    assert all(abs(kept[r.id] - r.deg / 20) < 0.011 for r in degree.collect())


def test_schedules():
    assert [epoch_distribution(1000, 3, s) for s in ("fast", "accurate", "s-fast", "s-accurate", "normal")] == [[500, 250, 125], [125, 250, 500], [416, 291, 228], [228, 291, 416], [333] * 3]
    assert epoch_distribution(4, 4, "fast") == [2, 1, 1, 1] and epoch_distribution(9, 1) == [9]
    assert len(parameter_grid()) == 72
    config = parse_args(["--input", "a", "--output", "b", "--epochs", "7", "--wedge", "--alpha", "50"])
    assert (config.epochs, config.wedge, config.alpha, config.dimension) == (7, True, 50, 128) and "alpha: 50" in config.describe()
    with pytest.raises(ValueError):
        EmbedConfig(parts=21)
    assert [sc.pretty_bytes(n) for n in (12, 2048, 3 * 1024**3)] == ["12 B", "2.0 KB", "3.0 GB"]


def test_scalars(spark):
    x = [-6.0, 0.0, 1.5, 5.99, 6.0, -6.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(sc.table_sigmoid(F.col("x"))).collect()]
    assert got == pytest.approx([0.002473, 0.5, 0.817574, 0.997498, 1, 0], abs=1e-6)


def test_samplers_stay_on_arcs(tiny, spark):
    _, arcs, degree, placed = tiny
    near = {(r.src, r.dst) for r in arcs.collect()}
    for epoch in range(5):
        assert all((r.src, r.dst) in near for r in sampling.neighbours(placed, degree, epoch).collect())
    assert all(any((r.src, m) in near and (m, r.dst) in near for m in range(7)) for r in sampling.wedges(placed, degree).collect())
    for r in sampling.walks(placed, degree, 50, 6).collect():
        assert all(p in near for p in zip(r.path, r.path[1:])) and len(r.path) == 7
    assert sampling.outside(sampling.negatives(spark.range(7), 7, 3), 7).count() == 0
    many = sampling.negatives(spark.range(4000), 10, 5).groupBy("dst").count().collect()
    assert len(many) == 10 and all(abs(r["count"] - 2000) < 250 for r in many)
    steps = sampling.pagerank_walks(placed, degree, 50, keep_still=True)
    assert steps.count() == 7
    weighted = spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "id long, w long")
    asked = spark.range(4000).select((F.col("id") / 4000).alias("u"))
    assert {r.dst: r["count"] for r in sampling.weighted_draws(asked, weighted).groupBy("dst").count().collect()} == {0: 1000, 2: 3000}


def test_matrix(tiny, spark):
    edges, arcs, degree, _ = tiny
    coo = arcs.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    ones = spark.range(7).select(F.col("id").alias("j"), F.lit(1.0).alias("x"))
    rows = spark.range(8).select(F.col("id").alias("i"))
    assert [r.y for r in matrix.spmv(coo, ones, rows).orderBy("i").collect()] == [3, 2, 4, 3, 3, 4, 1, 0]
    lined = spark.createDataFrame([(0, 1, 5), (0, 2, 70000), (1, 0, 70001)], "i long, j long, line long")
    assert matrix.is_sorted(lined).first()[0] and not matrix.is_sorted(lined.withColumn("line", -F.col("line"))).first()[0]


def test_matrix_market(spark, tmp_path, monkeypatch):
    text = tmp_path / "a.mtx"
    text.write_text("%%MatrixMarket matrix coordinate integer skew-symmetric\n% note\n3 3 2\n2 1 5\n3 2 7\n")
    coo, kind, sizes = mm.read_matrix(spark, str(text))
    assert sizes == (3, 3, 2) and kind.symmetry == "skew-symmetric"
    assert lists(coo, "i", "j", "v") == [(0, 1, -5.0), (1, 0, 5.0), (1, 2, -7.0), (2, 1, 7.0)]
    mm.write_matrix(coo, str(tmp_path / "b"), 3, 3)
    again, kind, _ = mm.read_matrix(spark, str(tmp_path / "b"))
    assert lists(again, "i", "j", "v") == lists(coo, "i", "j", "v") and str(kind) == "matrix coordinate real general"
    text.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    assert lists(mm.read_matrix(spark, str(text))[0], "i", "j", "v") == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
    text.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 2 0\n2 1 2 3\n")
    assert lists(mm.read_matrix(spark, str(text))[0], "i", "j", "v", "im") == [(0, 0, 2.0, 0.0), (0, 1, 2.0, -3.0), (1, 0, 2.0, 3.0), (1, 1, 0.0, 0.0)][:3]
    text.write_text("%%MatrixMarket matrix array real general\n% by columns\n2 3\n1\n2\n3\n4\n5\n6\n")
    dense, kind, sizes = mm.read_matrix(spark, str(text))
    assert sizes == (2, 3) and lists(dense, "i", "j", "v") == [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0), (1, 0, 2.0), (1, 1, 4.0), (1, 2, 6.0)]
    for symmetry, low in (("symmetric", 0), ("skew-symmetric", 1)):
        n, values = 40, iter(range(1, 2000))
        want = {(i, j): float(next(values)) for j in range(n) for i in range(j + low, n)}
        coo = spark.createDataFrame([(i, j, v) for (i, j), v in want.items()], "i long, j long, v double")
        mm.write_matrix(coo, str(tmp_path / symmetry), n, n, mm.Kind(format="array", symmetry=symmetry))
        again, _, sizes = mm.read_matrix(spark, str(tmp_path / symmetry), whole=False)
        assert sizes == (n, n) and {(r.i, r.j): r.v for r in again.collect()} == want
    text.write_text("2 2 1\n1 2 4\n")
    with pytest.raises(mm.MatrixMarketError):
        mm.read_matrix(spark, str(text))
    assert lists(mm.read_matrix(spark, str(text), strict=False)[0], "i", "j", "v") == [(0, 1, 4.0)]
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"%%MatrixMarket matrix coordinate real general\n2 2 1\n2 1 3.5\n")))
    assert lists(mm.read_matrix(spark, "-")[0], "i", "j", "v") == [(1, 0, 3.5)]
    assert not mm.Kind(format="array", field="pattern").valid and not mm.Kind(symmetry="hermitian").valid


def test_folders_of_parts_of_unlike_sizes(spark, tmp_path):
    """Spark packs larger files first; lines still come by the files' names."""
    parts = tmp_path / "emb"
    parts.mkdir()
    (parts / "part-00000").write_text("4 1\n0 0.5\n")
    (parts / "part-00001").write_text("1 1.5\n2 2.50000000000000000000\n3 3.5\n")
    assert sorted(map(tuple, ve.read_text(spark, str(parts)).collect())) == [(0, [0.5]), (1, [1.5]), (2, [2.5]), (3, [3.5])]
    lined = tmp_path / "edges"
    lined.mkdir()
    for k, size in enumerate((2, 40, 5)):
        (lined / f"part-{k}").write_text("# note\n" + "".join(f"{100 * k + i} {i}\n" for i in range(size)))
    got = ed.read_edge_list(spark, str(lined), lines=True).orderBy("line").collect()
    assert [r.line for r in got] == list(range(47)) and [r.src for r in got] == [100 * k + i for k, size in enumerate((2, 40, 5)) for i in range(size)]
    n = 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    emb = spark.range(0, n, 1, 7).select("id", F.array((F.col("id") / 4).alias("x"), -F.col("id").cast("double")).alias("vec"))
    ve.write_text(emb, str(tmp_path / "t"), 2)
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]) > 1
    assert sorted((r.id, *r.vec) for r in ve.read_text(spark, str(tmp_path / "t")).collect()) == [(i, i / 4, -float(i)) for i in range(n)]
    coo = spark.range(0, n, 1, 5).select((F.col("id") % 50).alias("i"), F.floor(F.col("id") / 50).alias("j"), (F.col("id") * 1.5).cast("double").alias("v"))
    mm.write_matrix(coo, str(tmp_path / "m"), 50, 10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again, _, sizes = mm.read_matrix(spark, str(tmp_path / "m"))
    assert sizes == (50, 10, n) and lists(again, "i", "j", "v") == lists(coo, "i", "j", "v")


def test_edge_files(spark, tmp_path):
    text = tmp_path / "e.txt"
    text.write_text("% a\n# b\n0 3\n1\t4 2.5\n\n5 5\n")
    assert lists(ed.read_edge_list(spark, str(text)), "src", "dst", "w") == [(0, 3, None), (1, 4, 2.5), (5, 5, None)]
    ed.write_edge_list(ed.read_edge_list(spark, str(text)).drop("w"), str(tmp_path / "out"))
    assert lists(ed.read_edge_list(spark, str(tmp_path / "out")), "src", "dst") == [(0, 3), (1, 4), (5, 5)]
    np.array([0, 3, 4, 1], "<u4").tofile(tmp_path / "e.bin")
    assert lists(ed.read_binary_edges(spark, str(tmp_path / "e.bin")), "src", "dst") == [(0, 3), (4, 1)]
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(TINY)], "src long, dst long, line long")
    placed = graph.slots(graph.symmetrize(edges), "line", "side").withColumn("w", F.col("src") + F.col("dst"))
    ed.write_binary_csr(placed, 8, str(tmp_path / "g.bcsr"))
    assert lists(ed.read_binary_csr(spark, str(tmp_path / "g.bcsr"), True), "src", "dst", "pos", "w") == lists(placed, "src", "dst", "pos", "w")


def test_binary_files_by_range(spark, tmp_path, monkeypatch):
    """Files of several ranges and pieces read back as written."""
    for name in ("VERTICES", "ARCS"):
        monkeypatch.setattr(ed, name, 7)
    edges = spark.range(0, 300, 1, 5).select((F.col("id") % 40).alias("src"), (F.col("id") * 7 % 41).alias("dst"))
    placed = graph.slots(edges.withColumn("k", F.col("dst") * 1000), "k", "dst").withColumn("w", F.col("src") + F.col("dst"))
    ed.write_binary_csr(placed, 45, str(tmp_path / "g.bcsr"))
    assert lists(ed.read_binary_csr(spark, str(tmp_path / "g.bcsr"), True), "src", "dst", "pos", "w") == lists(placed, "src", "dst", "pos", "w")
    monkeypatch.setattr(ed, "BLOCK_BYTES", 64)
    ed.write_binary_edges(edges, str(tmp_path / "e.bin"), "src", "dst")
    assert lists(ed.read_binary_edges(spark, str(tmp_path / "e.bin")), "src", "dst") == lists(edges, "src", "dst")
    monkeypatch.setattr(ve, "BLOCK_BYTES", 64)
    emb = spark.range(0, 100, 1, 4).select("id", F.array((F.col("id") % 10).cast("double"), F.col("id").cast("double")).alias("vec"))
    ve.write_binary(emb, str(tmp_path / "v.bin"), 100, 2)
    assert [(r.id, *r.vec) for r in ve.read_binary(spark, str(tmp_path / "v.bin")).orderBy("id").collect()] == [(i, i % 10, i) for i in range(100)]
    ve.write_sorted_binary(emb, str(tmp_path / "s.bin"), 100, 2)
    assert [r.vec[1] for r in ve.read_binary(spark, str(tmp_path / "s.bin")).orderBy("id").collect()] == sorted(range(100), key=lambda i: (-(i % 10), i))
    assert lists(ed.distinct_ends(spark.createDataFrame([(1, 5), (5, 5), (9, 1)], "src long, dst long")), "id") == [(1,), (5,), (9,)]


def test_whole_run(spark, tmp_path, capsys):
    """The small graph from its file to the cut report, the orders and the figures, by flags and by positions."""
    from weftgraph.__main__ import main

    text, out = tmp_path / "input1.txt", tmp_path / "output1.txt"
    text.write_text("".join(f"{a} {b}\n" for a, b in TINY))
    assert main(["--input", str(text), "--output", str(out), "--epochs", "4", "--dimension", "4"]) == 0
    said = capsys.readouterr().out
    assert "epochs: [5]" in said and "levels: [7]" in said and "loss: " in said and "budget: 0 B" in said  # 4 * 20 / 7 / 2
    before, after = (tmp_path / "output1_CUT.txt").read_text().split()
    assert before == "4" and 0 < int(after) <= 10
    emb = {r.id: list(r.vec) for r in ve.read_text(spark, str(out)).collect()}
    ranked = [r.value.split()[0] for r in spark.read.text(str(tmp_path / "output1_SORTED.txt")).collect()][1:]
    assert len(emb) == 7 and [int(k) for k in ranked] == sorted(emb, key=lambda k: (-emb[k][0], k))
    near = [tuple(map(int, r.value.split())) for r in spark.read.text(str(tmp_path / "output1_ADJ.txt")).collect()]
    assert sorted(near) == sorted(TINY)
    placed = graph.slots(graph.symmetrize(spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(TINY)], "src long, dst long, line long")), "line", "side")
    ed.write_binary_csr(placed, 7, str(tmp_path / "g.bcsr"))
    made = tmp_path / "o.bin"
    assert main(["--input", str(tmp_path / "g.bcsr"), "--format", "binary-csr", "--output", str(made), "--epochs", "1", "--dimension", "2", "--binary-output", "--memory", "1000000000"]) == 0
    assert (tmp_path / "o_CUT.bin").read_text().split()[0] == "4" and ve.read_binary(spark, str(made)).count() == 7
    assert len((tmp_path / "o_SORTED.bin").read_bytes()) == 8 + 7 * 2 * 4
    values = [str(text), "2", "3", "2", "0.025", "5", "0", "0", "0", "s-fast", "0.5", "1000", "0.8", "400", "100", "1", "0", "3", "4", "1", "1", "1", "1", "0", "10", "3", "1000", "0", "0", "0", "1", str(tmp_path / "p.txt")]
    capsys.readouterr()
    assert main(values) == 0 and "negatives: 3" in capsys.readouterr().out and (tmp_path / "p_CUT.txt").read_text().split()[0] == "4"


def test_parts_by_memory_and_rounds(spark):
    config = EmbedConfig(dimension=128, memory=500_000_000)
    assert train.parts_of(1_000_000, 10_000_000, config) == 5 and train.parts_of(1000, 1000, config) == 1
    _, edges = planted(spark)
    emb, report = train.embed(edges, EmbedConfig(epochs=1, dimension=4, sampling=1, pool=96))
    assert emb.count() == 200 and report["parts"] == [1]
    assert train.embed(edges, EmbedConfig(epochs=2, dimension=2), coarsen=False)[1]["epochs"] == [int(2 * edges.count() * 2 / 200 / 2)]


def test_vectors_and_timing(spark):
    assert [r.x for r in matrix.vector(spark, 3).collect()] == [1.0] * 3
    x = [r.x for r in matrix.vector(spark, 1000, 5).collect()]
    assert -1 <= min(x) < -0.9 and 0.9 < max(x) < 1
    coo = spark.createDataFrame([(0, 1, 2.0)], "i long, j long, v double")
    row = matrix.timed_products(coo, matrix.vector(spark, 2), spark.range(2).withColumnRenamed("id", "i"), 2).first()
    assert row.times == 2 and row.seconds > 0


def test_weighted_draws_at_any_number_of_buckets(spark):
    weighted = spark.range(300).select("id", (F.col("id") * 37 % 11 * F.when(F.col("id") == 7, 5000).otherwise(1)).alias("w"))
    asked = spark.range(3000).select("id", (F.col("id") / 3000).alias("u")).withColumnRenamed("id", "k")
    want = {r.k: r.dst for r in sampling.weighted_draws(asked, weighted, 1).collect()}
    assert len(want) == 3000
    for buckets in (None, 13, 5000):
        assert {r.k: r.dst for r in sampling.weighted_draws(asked, weighted, buckets).collect()} == want


def test_components(spark, monkeypatch):
    draw = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 1)]
    label = {}
    near = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for a in sorted(near):
        ahead = [a] if a not in label else []
        while ahead:
            n = ahead.pop()
            if n not in label:
                label[n] = a
                ahead += near[n]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    monkeypatch.setattr(components, "TASK_LINKS", 50)
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_vector_files(spark, tmp_path):
    emb = spark.createDataFrame([(1, [0.5, -1.25]), (0, [2.0, 3.0])], "id long, vec array<double>")
    ve.write_text(emb, str(tmp_path / "t"), 2)
    assert sorted(map(tuple, ve.read_text(spark, str(tmp_path / "t")).collect())) == [(0, [2.0, 3.0]), (1, [0.5, -1.25])]
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["2 2", "0 2.000000 3.000000 ", "1 0.500000 -1.250000 "]
    ve.write_sorted_text(emb, str(tmp_path / "s"), 2)
    assert [r.value.split()[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["2", "0", "1"]
    ve.write_binary(emb, str(tmp_path / "b.bin"), 2, 2)
    assert [list(r.vec) for r in ve.read_binary(spark, str(tmp_path / "b.bin")).orderBy("id").collect()] == [[2.0, 3.0], [0.5, -1.25]]
    assert ve.stem_path("/a/output1.txt", "_CUT") == "/a/output1_CUT.txt" and ve.stem_path("/a.b/out", "_CUT") == "/a.b/out_CUT"
    ve.write_cut(4, 3, str(tmp_path / "output1_pos1_alpha0.5_neg1_lr0.1_sm0_bloom0.txt"))
    assert [tuple(r) for r in ve.read_results(spark, str(tmp_path / "*_CUT.txt")).collect()] == [(1, 1, 0.5, 1, 0.1, 0, 0, 4, 3)]


def test_ranking(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("x"))
    ranked = global_rank(df, F.col("x"))
    assert ranked.where("rank <> x").count() == 0 and ranked.count() == 1000
    assert sums_before(df, "id", "x", "s", block=64).where("s < 0").count() == 0
    total = [r.s for r in sums_before(df, "id", "x", "s", block=64).orderBy("id").collect()]
    assert total == [0, *np.cumsum([i * 37 % 1000 for i in range(999)]).tolist()]
    parts = [r[0] for r in spark.range(8).orderBy("id").select(balanced_part(F.col("id"), F.lit(8), 3)).collect()]
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2]


def planted(spark):
    draw = random.Random(1)
    pairs = [(a, b) for a in range(200) for b in range(a) if draw.random() < (0.15 if (a < 100) == (b < 100) else 0.01)]
    return pairs, spark.createDataFrame(pairs, "src long, dst long")


def auc(pairs, emb):
    vec = {r.id: np.array(r.vec) for r in emb.collect()}
    draw, known = random.Random(3), set(pairs) | {(b, a) for a, b in pairs}
    other = [p for p in ((draw.randrange(200), draw.randrange(200)) for _ in range(3000)) if p not in known and p[0] != p[1]]
    hit = np.array([vec[a] @ vec[b] for a, b in pairs])
    miss = np.array([vec[a] @ vec[b] for a, b in other])
    return (hit[:, None] > miss).mean()


def test_training_separates_blocks(spark):
    pairs, edges = planted(spark)
    emb, report = train.embed(edges.cache(), EmbedConfig(epochs=300, dimension=16, negatives=3))
    assert report["levels"] == [200] and auc(pairs, emb) >= 0.75
    assert train.reorder_report(edges, emb).first()["before"] > 0


def test_training_in_a_task_is_the_distributed_one(spark, monkeypatch):
    _, edges = planted(spark)
    config = EmbedConfig(epochs=2, dimension=4)
    inside, _ = train.embed(edges, config, coarsen=False)
    monkeypatch.setattr(train, "TASK_CELLS", 0)
    spread, _ = train.embed(edges, config, coarsen=False)
    a, b = (np.array([r.vec for r in x.orderBy("id").collect()]) for x in (inside, spread))
    assert np.allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("options", [{"sampling": 1}, {"wedge": True}, {"alpha": 50, "bloom": True}, {"parts": 3}])
def test_training_paths(spark, options):
    _, edges = planted(spark)
    emb, _ = train.embed(edges, EmbedConfig(epochs=1, dimension=4, **options))
    rows = emb.collect()
    assert len(rows) == 200 and all(math.isfinite(x) for r in rows for x in r.vec)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 1, 2), ("2024-01-01 00:20:00", 1, 3), ("2024-01-01 02:00:00", 2, 1)], "t string, src long, dst long").selectExpr("cast(t as timestamp) ts", "src", "dst").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, src long, dst long").parquet(str(tmp_path / "in"))
    run = windowed_degrees(stream).writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.window_start.hour, r.id, r.deg) for r in spark.table("deg").collect()) == [(0, 1, 2), (0, 2, 1), (0, 3, 1), (2, 1, 1), (2, 2, 1)]


def test_sizing():
    from weftgraph.plans import sizing

    assert sizing.fits(10, 20, 4, 10 * 16 + 31 * 4) and not sizing.fits(10, 20, 4, 10 * 16 + 31 * 4 - 1)
    parts, size = sizing.part_count(1_000_000, 128, 500_000_000)
    assert (parts, size) == (5, 200_000)
    with pytest.raises(ValueError):
        sizing.part_count(10**9, 128, 10**9)
    assert sizing.pool_rounds(2_500_000) == (2, 999_936) and sizing.pool_rounds(10) == (0, 0)
    assert sizing.sample_priority(1, 3, 2, 1) == 17
    assert sizing.parts_ahead(3, 0) == [0, 1] and sizing.parts_ahead(3, 5) == [0, 1]
