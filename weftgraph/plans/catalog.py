"""The engine's queries by name, each with equivalent SQL where SQL can express it.

Production graphs: `cp` customers and the parts they ordered, `ps` parts and suppliers, `us` users whose events follow
one another (simple, undirected). SQL texts are put together from named table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import STRATEGIES, EmbedConfig, epoch_distribution, parameter_grid
from weftgraph.functions import scalars as sc
from weftgraph.operators import bloom, coarsen, graph, matrix, order, sampling, train
from weftgraph.plans import sizing
from weftgraph.plans.lineage import cut
from weftgraph.sources import tables
from weftgraph.sources.edges import distinct_ends

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

P = sc.PRIME
#: Table expressions that the SQL texts draw on, in an order in which they can be defined.
PARTS = {
    "cp": "SELECT DISTINCT o_custkey AS src, (SELECT count(*) FROM customer) + l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "ps": "SELECT DISTINCT l_partkey AS src, (SELECT count(*) FROM part) + l_suppkey AS dst FROM lineitem",
    "uu": "SELECT src, dst, count(*) AS w FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst",
    "us": "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM uu",
    "mtx": "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2",
    "lined": "SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS line FROM cp",
    "arcs": "SELECT src, dst, line, 0 AS side FROM lined UNION ALL SELECT dst, src, line, 1 FROM lined",
    "vert": "SELECT range AS id FROM range((SELECT max(greatest(src, dst)) + 1 FROM cp))",
    "deg": "SELECT id, count(src) AS deg FROM vert LEFT JOIN arcs ON id = src GROUP BY id",
    "slot": "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY line, side) - 1 AS pos FROM arcs",
    "uarcs": "SELECT src, dst FROM us UNION ALL SELECT dst, src FROM us",
    "udeg": "SELECT src AS id, count(*) AS deg FROM uarcs GROUP BY src",
    "jac": "SELECT e.src, e.dst, count(b.src) AS common, any_value(x.deg) + any_value(y.deg) - count(b.src) AS joint FROM us e JOIN udeg x ON x.id = e.src JOIN udeg y ON y.id = e.dst JOIN uarcs a ON a.src = e.src LEFT JOIN uarcs b ON b.src = e.dst AND b.dst = a.dst GROUP BY e.src, e.dst",
    "bits": "SELECT DISTINCT src AS id, ((dst * f.a + f.b) % 128)::INT AS bit FROM arcs, (VALUES (37, 1013), (151, 229)) AS f(a, b)",
    "pop": "SELECT id, count(*) AS bits FROM bits GROUP BY id",
    "shared": "SELECT e.src, e.dst, count(y.bit) AS shared FROM cp e JOIN bits x ON x.id = e.src LEFT JOIN bits y ON y.id = e.dst AND y.bit = x.bit GROUP BY e.src, e.dst",
    "approx": "SELECT s.src, s.dst, shared, shared // 2 AS c, p.bits + q.bits - shared // 2 AS den FROM shared s JOIN pop p ON p.id = s.src JOIN pop q ON q.id = s.dst",
    "hop": f"SELECT id AS src, dst FROM deg JOIN slot ON slot.src = id AND pos = {sc.draw_sql('id')} % deg WHERE deg > 0",
    "cmap": "SELECT id, id // 4 AS super FROM vert",
}
DEPENDS = {"us": "uu", "lined": "cp", "arcs": "lined", "vert": "cp", "deg": "vert arcs", "slot": "arcs", "uarcs": "us", "udeg": "uarcs", "jac": "us udeg", "bits": "arcs", "pop": "bits", "shared": "cp bits", "approx": "shared pop", "hop": "deg slot", "cmap": "vert"}


def with_parts(body: str, names: str, extra: str = "", recursive: bool = False) -> str:
    needed: set[str] = set()

    def need(name: str) -> None:
        for other in DEPENDS.get(name, "").split():
            need(other)
        needed.add(name)

    for name in names.split():
        need(name)
    listed = [f"{n} AS MATERIALIZED ({q})" for n, q in PARTS.items() if n in needed] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(listed)} {body}" if listed else body


def query(sql: str | None = None, parts: str = "", extra: str = "", recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_parts(sql, parts, extra, recursive)
        return f

    return add


def cp(spark, d):
    return tables.customer_part(spark, d)


def cp_arcs(spark, d):
    return graph.symmetrize(cp(spark, d))


def us(spark, d):
    return graph.simple(tables.user_transitions(spark, d))


def cp_degree(spark, d):
    edges = cp(spark, d)
    return graph.degrees(graph.vertices(edges), graph.symmetrize(edges))


def cp_slots(spark, d):
    """(degree, slots, n) of cp in (src, dst) line order, worked out once. The pair itself stands for the line, so nothing is numbered first."""
    edges = cut(cp(spark, d))
    arcs = graph.symmetrize(edges.withColumn("a", F.col("src")).withColumn("b", F.col("dst")))
    n, _ = graph.size_of(edges)
    return cut(graph.degrees(spark.range(n), arcs)), cut(graph.slots(arcs, "a", "b", "side")), n


# graph -----------------------------------------------------------------------------------------------------------------
@query("SELECT src, dst FROM arcs", "arcs")
def g_symmetrize(spark, d):
    return cp_arcs(spark, d).select("src", "dst")


@query("SELECT max(greatest(src, dst)) + 1 AS n, count(*) AS lines FROM cp", "cp")
def g_vertex_domain(spark, d):
    return graph.domain(cp(spark, d))


@query("SELECT id, deg FROM deg", "deg")
def g_degree(spark, d):
    return cp_degree(spark, d)


@query("SELECT src AS id FROM cp UNION SELECT dst FROM cp", "cp")
def g_distinct_ends(spark, d):
    return distinct_ends(cp(spark, d))


@query("SELECT deg, count(*) AS n FROM deg GROUP BY deg", "deg")
def g_degree_hist(spark, d):
    return graph.degree_histogram(cp_degree(spark, d))


@query("SELECT id, deg, (sum(deg) OVER (ORDER BY id) - deg)::BIGINT AS off FROM deg", "deg")
def g_csr_offsets(spark, d):
    return graph.offsets(cp_degree(spark, d))


@query("SELECT src, dst, pos FROM slot", "slot")
def g_csr_slots(spark, d):
    return cp_slots(spark, d)[1]


@query("SELECT id, deg, row_number() OVER (ORDER BY deg DESC, id DESC) - 1 AS rank FROM deg", "deg")
def g_visit_order(spark, d):
    return graph.visit_order(cp_degree(spark, d))


@query("SELECT id FROM deg WHERE deg = 0", "deg")
def g_isolated(spark, d):
    edges = cp(spark, d)
    return graph.isolated(graph.vertices(edges), edges)


@query("SELECT id, deg FROM deg WHERE deg > 0 AND deg < (SELECT sum(deg)::BIGINT // count(*) FROM deg) + 1", "deg")
def g_eligible(spark, d):
    return graph.eligible(cp_degree(spark, d))


@query("SELECT DISTINCT a.src, a.dst FROM uu a WHERE EXISTS (SELECT 1 FROM uu b WHERE b.src = a.dst AND b.dst = a.src)", "uu")
def g_has_edge(spark, d):
    arcs = tables.user_transitions(spark, d)
    return graph.has_edge(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), arcs)


@query("SELECT count(*) AS n, sum(deg)::BIGINT AS m, sum(deg)::BIGINT // count(*) AS density FROM deg", "deg")
def g_density(spark, d):
    return graph.density(cp_degree(spark, d))


@query("SELECT max(abs(src - dst)) AS bandwidth FROM cp", "cp")
def g_bandwidth(spark, d):
    return graph.bandwidth(cp(spark, d))


@query("SELECT a.src AS id, count(*) AS paths FROM arcs a JOIN arcs b ON a.dst = b.src GROUP BY a.src", "arcs")
def g_two_hop(spark, d):
    edges = cp(spark, d)
    return graph.two_hop_counts(graph.symmetrize(edges), graph.degrees(graph.vertices(edges), graph.symmetrize(edges)))


@query("SELECT src, dst, common, joint, common / joint AS jaccard FROM jac", "jac")
def g_jaccard(spark, d):
    return graph.jaccard(us(spark, d))


@query("SELECT id, best, max_j AS jaccard FROM (SELECT src AS id, dst AS best, common / joint AS max_j, row_number() OVER (PARTITION BY src ORDER BY common / joint DESC, dst) AS r FROM (SELECT src, dst, common, joint FROM jac UNION ALL SELECT dst, src, common, joint FROM jac) WHERE common > 0) WHERE r = 1", "jac")
def g_best_jaccard(spark, d):
    return graph.best_neighbour(graph.mirrored(graph.jaccard(us(spark, d))))


@query("SELECT src, dst, common FROM jac UNION ALL SELECT dst, src, common FROM jac", "jac")
def g_reverse_arc(spark, d):
    return graph.mirrored(graph.jaccard(us(spark, d)).select("src", "dst", "common"))


# signatures ------------------------------------------------------------------------------------------------------------
@query("SELECT id, bit FROM bits", "bits")
def b_bits(spark, d):
    return bloom.bits(cp_arcs(spark, d))


@query(
    "SELECT p.src, p.dst, x.bit IS NOT NULL AND y.bit IS NOT NULL AS maybe FROM (SELECT src, dst + 1 AS dst FROM cp) p LEFT JOIN bits x ON x.id = p.src AND x.bit = ((p.dst * 37 + 1013) % 128)::INT LEFT JOIN bits y ON y.id = p.src AND y.bit = ((p.dst * 151 + 229) % 128)::INT",
    "cp bits",
)
def b_may_have(spark, d):
    edges = cp(spark, d)
    return bloom.may_have(edges.select("src", (F.col("dst") + 1).alias("dst")), bloom.signatures(graph.symmetrize(edges)))


@query("SELECT id, bits FROM pop", "pop")
def b_popcount(spark, d):
    return bloom.popcounts(bloom.signatures(cp_arcs(spark, d)))


@query("SELECT src, dst, shared, shared // 2 AS c FROM shared", "shared")
def b_common(spark, d):
    return b_scores(spark, d).select("src", "dst", "shared", "c")


def b_scores(spark, d):
    edges = cp(spark, d)
    return bloom.approximate_jaccard(edges, bloom.signatures(graph.symmetrize(edges)))


@query("SELECT src, dst, c, den, round(c / den, 6) AS approx FROM approx", "approx")
def b_approx_jaccard(spark, d):
    return b_scores(spark, d).select("src", "dst", "c", "den", F.round("approx", 6).alias("approx"))


@query("SELECT round(avg(c / den), 6) AS average FROM approx", "approx")
def b_avg(spark, d):
    return bloom.average(b_scores(spark, d)).select(F.round("average", 6).alias("average"))


# orders ----------------------------------------------------------------------------------------------------------------
EMB = "emb AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x FROM embeddings)"


@query("SELECT id, x, row_number() OVER (ORDER BY x DESC, id) - 1 AS rank FROM emb", extra=EMB)
def o_sort_emb(spark, d):
    return order.by_coordinate(tables.vectors(spark, d))


@query("SELECT id, n, (ntile(n) OVER (PARTITION BY n ORDER BY x DESC, id) - 1)::INT AS part FROM emb, (VALUES (2), (3), (8)) AS k(n)", extra=EMB)
def o_partition(spark, d):
    ranked = cut(order.by_coordinate(tables.vectors(spark, d)))
    made = [order.partition(ranked, n).select("id", F.lit(n).alias("n"), "part") for n in (2, 3, 8)]
    return made[0].unionByName(made[1]).unionByName(made[2])


CUT = "SELECT count(*) AS cut FROM cp JOIN parts a ON a.id = src JOIN parts b ON b.id = dst WHERE a.part <> b.part"


@query(CUT, "vert", "parts AS (SELECT id, ntile(2) OVER (ORDER BY id) AS part FROM vert)")
def o_cut_id(spark, d):
    edges = cp(spark, d)
    return order.cut_of(edges, order.partition(graph.vertices(edges).select("id", F.col("id").alias("rank")), 2))


@query(CUT, "vert", f"parts AS (SELECT id, ntile(2) OVER (ORDER BY {sc.draw_sql('id')} DESC, id) AS part FROM vert)")
def o_cut_sorted(spark, d):
    edges = cp(spark, d)
    emb = graph.vertices(edges).select("id", F.array(sc.draw(F.col("id")).cast("double")).alias("vec"))
    return order.cut_of(edges, order.partition(order.by_coordinate(emb), 2))


@query(
    "SELECT src, dst, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 4) AS dist FROM us JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst",
    "us",
)
def o_edge_l1(spark, d):
    return order.edge_distances(us(spark, d), tables.vectors(spark, d)).select("src", "dst", F.round("dist", 4).alias("dist"))


@query("SELECT a.r AS src, b.r AS dst FROM cp JOIN ranked a ON a.id = src JOIN ranked b ON b.id = dst", "vert", f"ranked AS (SELECT id, row_number() OVER (ORDER BY {sc.draw_sql('id')}, id) - 1 AS r FROM vert)")
def o_relabel(spark, d):
    edges = cp(spark, d)
    emb = graph.vertices(edges).select("id", F.array(sc.draw(F.col("id")).cast("double")).alias("vec"))
    return order.relabel(edges, order.by_coordinate(emb, ascending=True))


@query("SELECT id, (id // ((n + 2) // 3))::INT AS part FROM vert, (SELECT count(*) AS n FROM vert)", "vert")
def o_part_range(spark, d):
    n, _ = graph.size_of(cp(spark, d))
    return order.part_ranges(spark.range(n), n, 3)


@query("SELECT (a * (a + 1) // 2 + b)::INT AS pair, a::INT AS a, b::INT AS b FROM range(7) AS x(a), range(7) AS y(b) WHERE b <= a")
def o_pair_lattice(spark, d):
    return order.pair_lattice(spark, 7)


@query(
    "SELECT k::INT AS at, p::INT AS part FROM (SELECT DISTINCT x.k, unnest([y.a, y.b]) AS p FROM l x, l y, range(1, 3) AS s(step) WHERE y.k = (x.k + step) % 28)",
    extra="l AS (SELECT a * (a + 1) // 2 + b AS k, a, b FROM range(7) AS x(a), range(7) AS y(b) WHERE b <= a)",
)
def o_parts_ahead(spark, d):
    return spark.createDataFrame([(k, p) for k in range(28) for p in sizing.parts_ahead(7, k)], "at int, part int")


@query("SELECT pool::INT AS pool, main::INT AS main, sub::INT AS sub, (pool * 25 + main * 5 + sub + 1)::INT AS priority FROM range(2) AS p(pool), range(5) AS m(main), range(5) AS s(sub)")
def s_sample_priority(spark, d):
    return spark.createDataFrame([(p, m, s, sizing.sample_priority(p, 5, m, s)) for p in range(2) for m in range(5) for s in range(5)], "pool int, main int, sub int, priority int")


@query(
    "SELECT src, dst, ps AS part_src, pd AS part_dst, (greatest(ps, pd) * (greatest(ps, pd) + 1) // 2 + least(ps, pd))::INT AS pair FROM (SELECT src, dst, (src // size)::INT AS ps, (dst // size)::INT AS pd FROM hop, (SELECT (count(*) + 2) // 3 AS size FROM vert))",
    "hop",
)
def o_part_pair_pool(spark, d):
    degree, placed, n = cp_slots(spark, d)
    return order.part_pair_pool(sampling.neighbours(placed, degree), n, 3)


@query()
def o_rcm(spark, d):
    return order.reverse_cuthill_mckee(tables.part_supplier(spark, d))


# Fixed values in the SQL of this file: the hash lines and bits of a signature and the grid's axes, as functions/scalars.py and config.py have them.
# matrices --------------------------------------------------------------------------------------------------------------
def x_of(rows: DataFrame, name: str = "j") -> DataFrame:
    return rows.select(F.col(name).alias("j"), (F.col(name) % 7 - 3).cast("double").alias("x"))


def row_ids(spark, d, of: str = "i") -> DataFrame:
    n = tables.quantities(spark, d).agg(F.max(of)).first()[0]
    return spark.range(0 if n is None else n + 1)


@query(f"SELECT range AS j, round({sc.draw_sql('range', seed=3)}::DOUBLE / {float(P)} * 2 - 1, 9) AS x FROM range((SELECT count(*) FROM part))")
def m_vector(spark, d):
    return matrix.vector(spark, tables.table(spark, d, "part").count(), 3).select("j", F.round("x", 9).alias("x"))


@query("SELECT i, j, v, row_number() OVER (ORDER BY i, j) - 1 AS rank FROM mtx", "mtx")
def m_coo_sorted(spark, d):
    from weftgraph.plans.ranking import global_rank

    return global_rank(tables.quantities(spark, d), F.col("i"), F.col("j"))


@query("SELECT (SELECT count(*) FROM (SELECT i, j, lag(i) OVER (ORDER BY k) AS pi, lag(j) OVER (ORDER BY k) AS pj FROM (SELECT l_partkey AS i, l_suppkey AS j, l_orderkey * 8 + l_linenumber AS k FROM lineitem)) WHERE pi > i OR pi = i AND pj > j) = 0 AS sorted")
def m_is_sorted(spark, d):
    lines = tables.table(spark, d, "lineitem")
    return matrix.is_sorted(lines.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")))


@query("SELECT r AS i, coalesce(sum(n) OVER (ORDER BY r) - n, 0)::BIGINT AS ptr FROM (SELECT range AS r, count(m.i) AS n FROM range((SELECT max(i) + 1 FROM mtx)) LEFT JOIN mtx m ON m.i = range GROUP BY range)", "mtx")
def m_row_ptr(spark, d):
    return matrix.row_pointers(tables.quantities(spark, d), row_ids(spark, d).withColumnRenamed("id", "i"))


SPMV = "SELECT range AS i, coalesce(sum(v * (j % 7 - 3)), 0)::DOUBLE AS y FROM range((SELECT max(i) + 1 FROM {m})) LEFT JOIN {m} m ON m.i = range GROUP BY range"


@query(SPMV.format(m="mtx"), "mtx")
def m_spmv(spark, d):
    coo = tables.quantities(spark, d)
    return matrix.spmv(coo, x_of(row_ids(spark, d, "j"), "id"), row_ids(spark, d).withColumnRenamed("id", "i"))


@query("SELECT i, 0.5 * y + 2.0 * (i % 5) AS y FROM (" + SPMV.format(m="mtx") + ")", "mtx")
def m_spmv_axpby(spark, d):
    coo, rows = tables.quantities(spark, d), row_ids(spark, d).withColumnRenamed("id", "i")
    return matrix.spmv(coo, x_of(row_ids(spark, d, "j"), "id"), rows, 0.5, rows.select("i", (F.col("i") % 5).cast("double").alias("y")), 2.0)


@query("SELECT src AS i, dst AS j, w::DOUBLE AS v FROM uu UNION ALL SELECT dst, src, -w::DOUBLE FROM uu WHERE src <> dst", "uu")
def m_symmetric(spark, d):
    coo = tables.user_transitions(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("v"))
    return matrix.mirrored(coo, "skew-symmetric")


@query("SELECT (i * 16 // n)::INT AS row, (j * 16 // n)::INT AS col, count(*) AS n FROM (SELECT i, j, greatest((SELECT max(i) FROM mtx), (SELECT max(j) FROM mtx)) + 1 AS n FROM mtx) GROUP BY 1, 2", "mtx")
def m_spy(spark, d):
    coo = tables.quantities(spark, d)
    n = coo.agg(F.greatest(F.max("i"), F.max("j"))).first()[0]
    return matrix.spy(coo, 16, (n or 0) + 1)


# scalars ---------------------------------------------------------------------------------------------------------------
@query(f"SELECT range AS cell, round(1 / (1 + exp(-(-{sc.BOUND} + range * {2 * sc.BOUND / sc.CELLS}))), 6) AS value FROM range({sc.CELLS})")
def s_sigmoid_table(spark, d):
    x = F.lit(-sc.BOUND) + F.col("id") * (2 * sc.BOUND / sc.CELLS)
    return spark.range(sc.CELLS).select(F.col("id").alias("cell"), F.round(sc.table_sigmoid(x), 6).alias("value"))


XS = "xs AS (SELECT range AS k, (range - 800)::DOUBLE / 100 AS x FROM range(1601))"


def xs(spark):
    return spark.range(1601).select(F.col("id").alias("k"), ((F.col("id") - 800).cast("double") / 100).alias("x"))


@query(f"SELECT k, round({sc.table_sigmoid_sql('x')}, 6) AS y FROM xs", extra=XS)
def s_fast_sigmoid(spark, d):
    return xs(spark).select("k", F.round(sc.table_sigmoid(F.col("x")), 6).alias("y"))


@query("SELECT k, round(1 / (1 + exp(-x)), 6) AS y FROM xs", extra=XS)
def s_logistic(spark, d):
    return xs(spark).select("k", F.round(sc.logistic(F.col("x")), 6).alias("y"))


DIST_CASES = ((1000, 3), (4, 4), (100, 1), (37, 6))


@query(
    """SELECT strategy, epochs, levels, level::INT AS level, CASE WHEN levels = 1 THEN epochs
 WHEN strategy = 'normal' THEN greatest(1, epochs // levels)
 WHEN strategy LIKE 's-%' THEN greatest(1, floor(epochs * 0.5::DOUBLE / levels + floor(0.5::DOUBLE * epochs * pow(0.5, k + 1)))::INT)
 ELSE greatest(1, floor(epochs * pow(0.5, k + 1))::INT) END AS n
 FROM (SELECT strategy, epochs, levels, level, CASE WHEN strategy LIKE '%accurate' THEN levels - 1 - level ELSE level END AS k
 FROM (VALUES ('fast'), ('accurate'), ('s-fast'), ('s-accurate'), ('normal')) AS s(strategy), (VALUES (1000, 3), (4, 4), (100, 1), (37, 6)) AS c(epochs, levels), range(6) AS r(level) WHERE level < levels)""",
)
def s_epoch_dist(spark, d):
    rows = [(s, e, n, k, x) for s in STRATEGIES for e, n in DIST_CASES for k, x in enumerate(epoch_distribution(e, n, s))]
    return spark.createDataFrame(rows, "strategy string, epochs int, levels int, level int, n int")


@query("SELECT range AS epoch, round(greatest(1 - range / 300.0::DOUBLE, 1e-4::DOUBLE) * 0.025::DOUBLE, 8) AS rate FROM range(301)")
def s_lr_decay(spark, d):
    return spark.range(301).select(F.col("id").alias("epoch"), F.round(sc.decayed_rate(F.lit(0.025), F.col("id"), F.lit(300.0)), 8).alias("rate"))


NS = "ns AS (SELECT range * 37000 + 1000 AS n FROM range(60))"


def ns(spark):
    return spark.range(60).select((F.col("id") * 37000 + 1000).alias("n"))


@query("SELECT n, round(CASE WHEN n > 100000 THEN 0.025::DOUBLE / sqrt(n // 100000) ELSE 0.025::DOUBLE END, 8) AS rate FROM ns", extra=NS)
def s_level_lr(spark, d):
    return ns(spark).select("n", F.round(sc.level_rate(F.lit(0.025), F.col("n")), 8).alias("rate"))


@query("SELECT n, floor(1000 * (n * 20)::DOUBLE / (n + 7) / 2)::BIGINT AS epochs FROM ns", extra=NS)
def s_epoch_scale(spark, d):
    return ns(spark).select("n", sc.scaled_epochs(F.lit(1000), F.col("n") * 20, F.col("n") + 7).alias("epochs"))


@query("SELECT n, level, level * level * (n // 400) AS cap FROM ns, range(1, 6) AS r(level)", extra=NS)
def s_match_cap(spark, d):
    return ns(spark).select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("level")).select("n", "level", sc.match_cap(F.col("level"), F.col("n")).alias("cap"))


@query("SELECT n, round(ln(n), 6) AS positive, round(ln(n // 3), 6) AS negative, round(ln(n / 3), 6) AS negative_part FROM ns", extra=NS)
def s_nce_bias(spark, d):
    n = F.col("n")
    return ns(spark).select("n", F.round(sc.positive_bias(n), 6).alias("positive"), F.round(sc.negative_bias(n, 3), 6).alias("negative"), F.round(sc.negative_bias(n, 3, False), 6).alias("negative_part"))


WEIGHTS = "w AS (SELECT id, round(pow(deg::DOUBLE, 0.75) * 1000)::BIGINT AS w FROM deg WHERE deg > 0)"


@query("SELECT id, w FROM w", "deg", WEIGHTS)
def s_neg_weight(spark, d):
    return sampling.weights(cp_degree(spark, d))


# samplers --------------------------------------------------------------------------------------------------------------
@query("SELECT src, dst FROM hop", "hop")
def p_hop(spark, d):
    degree, placed, _ = cp_slots(spark, d)
    return sampling.neighbours(placed, degree)


@query(
    "SELECT asked.src, slot.dst FROM asked JOIN slot ON slot.src = asked.mid AND slot.pos = asked.pos", "hop",
    f"asked AS MATERIALIZED (SELECT h.src, h.dst AS mid, {sc.draw_sql('h.src', k='1')} % deg.deg AS pos FROM hop h JOIN deg ON deg.id = h.dst)",
)
def p_wedge(spark, d):
    degree, placed, _ = cp_slots(spark, d)
    return sampling.wedges(placed, degree)


ALPHA = 50


@query(
    f"SELECT w.src, w.node AS dst, k AS steps FROM walk w WHERE k > 0 AND NOT r % 101 < {ALPHA}", "deg slot",
    f"walk AS (SELECT id AS src, id AS node, 0 AS k, {sc.draw_sql('id')} AS r FROM deg WHERE deg > 0 UNION ALL SELECT w.src, slot.dst, w.k + 1, {sc.draw_sql('w.src', k='w.k + 1')} FROM walk w JOIN deg ON deg.id = w.node JOIN slot ON slot.src = w.node AND pos = w.r % deg.deg WHERE w.r % 101 < {ALPHA})", True,
)
def p_ppr(spark, d):
    degree, placed, _ = cp_slots(spark, d)
    return sampling.pagerank_walks(placed, degree, ALPHA)


@query(f"SELECT id AS src, k::INT AS k, {sc.draw_sql('id', k='k + 100')} % (SELECT count(*) FROM vert) AS dst FROM vert, range(3) AS r(k)", "vert")
def p_negative(spark, d):
    n, _ = graph.size_of(cp(spark, d))
    return sampling.negatives(spark.range(n), n, 3)


CUM = "cum AS MATERIALIZED (SELECT id, sum(w) OVER (ORDER BY id) - w AS lo, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER () AS total FROM w)"


@query(
    "SELECT src, k, cum.id AS dst FROM asked JOIN cum ON p >= lo AND p < hi", "deg",
    f"{WEIGHTS}, {CUM}, asked AS (SELECT deg.id AS src, k::INT AS k, least(floor({sc.draw_sql('deg.id', k='k + 200')}::DOUBLE / {float(P)} * total)::BIGINT, total - 1) AS p FROM deg, range(3) AS r(k), (SELECT max(total)::BIGINT AS total FROM cum))",
)
def p_negative_deg(spark, d):
    degree, _, n = cp_slots(spark, d)
    return sampling.degree_negatives(spark.range(n), degree, 3)


WALKS = f"w AS (SELECT id, deg AS w FROM deg WHERE deg > 0), {CUM}, asked AS (SELECT range AS walk, least(floor({sc.draw_sql('range')}::DOUBLE / {float(P)} * total)::BIGINT, total - 1) AS p FROM range((SELECT count(*) // 4 FROM vert)), (SELECT max(total)::BIGINT AS total FROM cum)), step AS (SELECT walk, id AS node, 0 AS k FROM asked JOIN cum ON p >= lo AND p < hi UNION ALL SELECT s.walk, slot.dst, s.k + 1 FROM step s JOIN deg ON deg.id = s.node JOIN slot ON slot.src = s.node AND pos = {sc.draw_sql('s.walk', k='s.k + 1')} % deg.deg WHERE s.k < 5)"


def walked(spark, d):
    degree, placed, n = cp_slots(spark, d)
    return sampling.walks(placed, degree, n // 4, 5)


@query("SELECT walk, string_agg(node, ' ' ORDER BY k) AS path FROM step GROUP BY walk", "deg slot", WALKS, True)
def p_walks(spark, d):
    return walked(spark, d).select("walk", F.concat_ws(" ", F.col("path").cast("array<string>")).alias("path"))


@query("SELECT a.walk, a.k::INT AS i, (b.k - a.k)::INT AS gap, a.node AS src, b.node AS dst FROM step a JOIN step b ON a.walk = b.walk AND b.k - a.k BETWEEN 1 AND 3", "deg slot", WALKS, True)
def p_walk_pairs(spark, d):
    return sampling.window_pairs(walked(spark, d), 3)


@query(
    "SELECT w.id, coalesce(percent, 100)::INT AS percent, coalesce(other, w.id) AS other FROM w LEFT JOIN (SELECT id, percent, other FROM q WHERE id IS NOT NULL) t ON t.id = w.id", "deg",
    f"{WEIGHTS}, sh AS MATERIALIZED (SELECT id, w::DOUBLE * n / total AS s FROM w, (SELECT count(*) AS n, sum(w)::DOUBLE AS total FROM w)), "
    "q AS (SELECT (SELECT coalesce(list({'i': id, 's': s} ORDER BY id), []) FROM sh WHERE s < 1) AS u, (SELECT coalesce(list({'i': id, 's': s} ORDER BY id), []) FROM sh WHERE s >= 1) AS o, NULL::BIGINT AS id, 0 AS percent, NULL::BIGINT AS other "
    "UNION ALL SELECT CASE WHEN s2 < 1 THEN list_append(u[2:], {'i': o[1].i, 's': s2}) ELSE u[2:] END, CASE WHEN s2 >= 1 THEN list_append(o[2:], {'i': o[1].i, 's': s2}) ELSE o[2:] END, u[1].i, floor(100 * u[1].s + 1e-9)::INT, o[1].i "
    "FROM (SELECT *, o[1].s - (1 - u[1].s) AS s2 FROM q WHERE len(u) > 0 AND len(o) > 0))", True,
)
def p_alias(spark, d):
    return sampling.alias_table(sampling.weights(cp_degree(spark, d)))


# coarsening and training -----------------------------------------------------------------------------------------------
@query("SELECT DISTINCT a.super AS src, b.super AS dst FROM arcs JOIN cmap a ON a.id = src JOIN cmap b ON b.id = dst WHERE a.super <> b.super", "arcs cmap")
def c_contract(spark, d):
    edges = cp(spark, d)
    return coarsen.contract(graph.symmetrize(edges), graph.vertices(edges).select("id", F.floor(F.col("id") / 4).alias("super")))


HALF = "(({})::DOUBLE / " + str(float(P)) + " - 0.5)"


@query(
    "SELECT v.id, k::INT AS k, round(CASE WHEN v.id % 10 = 0 THEN " + HALF.format(sc.draw_sql("v.id", k="k")) + " ELSE " + HALF.format(sc.draw_sql("v.id // 4", k="k")) + " / 4 END, 6) AS x FROM vert v, range(4) AS r(k)", "vert",
)
def c_project(spark, d):
    ids = graph.vertices(cp(spark, d))
    coarse = train.initial(ids.select(F.floor(F.col("id") / 4).alias("id")).distinct(), 4)
    made = coarsen.project(coarse, ids.where("id % 10 <> 0").select("id", F.floor(F.col("id") / 4).alias("super")), ids, 4)
    return made.select("id", F.posexplode("vec").alias("k", "x")).select("id", "k", F.round("x", 6).alias("x"))


def match_sql(cap: int) -> str:
    """The sequential rule on ps: a step for each vertex in order; what is gone is carried along."""
    return ", ".join([
        "parcs AS MATERIALIZED (SELECT src, dst FROM ps UNION ALL SELECT dst, src FROM ps)",
        "pdeg AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM parcs GROUP BY src)",
        "plow AS MATERIALIZED (SELECT id FROM pdeg WHERE deg < (SELECT count(*) FROM parcs) // (SELECT max(src) + 1 FROM parcs) + 1)",
        "pnear AS MATERIALIZED (SELECT src AS id, list(dst ORDER BY dst) AS near FROM (SELECT DISTINCT src, dst FROM parcs WHERE src <> dst AND dst IN (SELECT id FROM plow)) GROUP BY src)",
        "pord AS MATERIALIZED (SELECT d.id, row_number() OVER (ORDER BY deg DESC, d.id DESC) AS r, coalesce(near, []) AS near FROM pdeg d LEFT JOIN pnear n ON n.id = d.id)",
        "g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS gone, []::BIGINT[] AS picks UNION ALL SELECT r, list_concat(gone, picks), picks FROM (SELECT o.r, g.gone, CASE WHEN list_contains(g.gone, o.id) THEN [] "
        f"ELSE list_concat([o.id], list_filter(o.near, lambda x: NOT list_contains(g.gone, x))[1:{cap}]) END AS picks FROM g JOIN pord o ON o.r = g.r + 1))",
    ])


MATCHED = "SELECT unnest(picks) AS id, super FROM (SELECT picks, row_number() OVER (ORDER BY r) - 1 AS super FROM g WHERE len(picks) > 0)"


def matched(spark, d, cap: int | None) -> DataFrame:
    edges = tables.part_supplier(spark, d)
    arcs = cut(graph.symmetrize(edges))
    degree = cut(graph.degrees(graph.vertices(edges), arcs))
    made = coarsen.match(arcs.withColumn("pos", F.col("dst")), degree, cap, task_offers=0)  # by rounds alone
    return coarsen.cluster_ids(cut(made), degree)


@query(MATCHED, "ps", match_sql(10**9), True)
def c_match(spark, d):
    return matched(spark, d, None)


@query(MATCHED, "ps", match_sql(3), True)
def c_match_capped(spark, d):
    return matched(spark, d, 3)


def levels_sql(most: int = 20) -> str:
    """The rule level by level: match, count the hubs, decide whether the level stays and whether another follows, contract."""
    config = EmbedConfig()
    made = ["s0 AS MATERIALIZED (SELECT max(greatest(src, dst)) + 1 AS n, true AS go FROM ps)", "a0 AS MATERIALIZED (SELECT src, dst FROM ps UNION ALL SELECT dst, src FROM ps)"]
    for k in range(1, most):
        b, cap = k - 1, f"{k * k} * ((SELECT n FROM s0) // {config.match_ratio})"
        made += [
            f"i{k} AS MATERIALIZED (SELECT * FROM a{b} WHERE (SELECT go FROM s{b}))",
            f"d{k} AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM i{k} GROUP BY src)",
            f"l{k} AS MATERIALIZED (SELECT id FROM d{k} WHERE deg < (SELECT count(*) FROM i{k}) // (SELECT n FROM s{b}) + 1)",
            f"o{k} AS MATERIALIZED (SELECT d.id, row_number() OVER (ORDER BY deg DESC, d.id DESC) AS r, coalesce(near, []) AS near FROM d{k} d LEFT JOIN (SELECT src AS id, list(dst ORDER BY dst) AS near FROM (SELECT DISTINCT src, dst FROM i{k} WHERE src <> dst AND dst IN (SELECT id FROM l{k})) GROUP BY src) n ON n.id = d.id)",
            f"g{k} AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS gone, []::BIGINT[] AS picks UNION ALL SELECT r, list_concat(gone, picks), picks FROM (SELECT o.r, g.gone, CASE WHEN list_contains(g.gone, o.id) THEN [] ELSE list_concat([o.id], list_filter(o.near, lambda x: NOT list_contains(g.gone, x))[1:{cap}]) END AS picks FROM g{k} g JOIN o{k} o ON o.r = g.r + 1))",
            f"c{k} AS MATERIALIZED (SELECT unnest(picks) AS id, super FROM (SELECT picks, row_number() OVER (ORDER BY r) - 1 AS super FROM g{k} WHERE len(picks) > 0))",
            f"k{k} AS MATERIALIZED (SELECT n, b.go AND NOT (n > {config.stop_precision} * was OR n < {config.stop_threshold} AND n <= {config.least_vertices}) AS keep FROM (SELECT count(DISTINCT super) AS n FROM c{k}), (SELECT n AS was, go FROM s{b}) b)",
            f"a{k} AS MATERIALIZED (SELECT DISTINCT x.super AS src, y.super AS dst FROM i{k} JOIN c{k} x ON x.id = src JOIN c{k} y ON y.id = dst WHERE x.super <> y.super AND (SELECT keep FROM k{k}))",
            f"s{k} AS MATERIALIZED (SELECT n, keep AND NOT (n < {config.stop_threshold} OR (SELECT count(*) FROM a{k}) = 0) AS go FROM k{k})",
        ]
    return ", ".join(made)


LEVELS = " UNION ALL ".join(["SELECT 0 AS level, n, (SELECT count(*) FROM a0) AS m FROM s0", *(f"SELECT {k}, n, (SELECT count(*) FROM a{k}) FROM k{k} WHERE keep" for k in range(1, 20))])


@query(LEVELS, "ps", levels_sql(), True)
def c_levels(spark, d):
    found = coarsen.levels(graph.symmetrize(tables.part_supplier(spark, d)), EmbedConfig())
    return spark.createDataFrame([(k, x["n"], x["m"]) for k, x in enumerate(found)], "level int, n long, m long")


def epoch_sql(sigmoid: Callable[[str], str], negative: str) -> str:
    """One epoch at dimension 4 in long form, rate 0.025, three negatives."""
    vec = f"e AS MATERIALIZED (SELECT v.id, k, {HALF.format(sc.draw_sql('v.id', k='k'))} / 4 AS x FROM vert v, range(4) AS r(k))"
    pairs = f"s AS MATERIALIZED (SELECT row_number() OVER () AS q, src, dst, y, b FROM (SELECT src, dst, 1.0::DOUBLE AS y, ln((SELECT count(*) FROM vert)) AS b FROM hop UNION ALL {negative}))"
    score = "g AS MATERIALIZED (SELECT q, src, dst, y, sum(v.x * u.x) - any_value(b) AS g FROM s JOIN e v ON v.id = src JOIN e u ON u.id = dst AND u.k = v.k GROUP BY q, src, dst, y)"
    coef = f"c AS MATERIALIZED (SELECT src, dst, (y - {sigmoid('g')}) * 0.025::DOUBLE AS f FROM g)"
    move = "m AS (SELECT id, k, sum(d) AS d FROM (SELECT src AS id, u.k, f * u.x AS d FROM c JOIN e u ON u.id = dst UNION ALL SELECT dst, v.k, f * v.x FROM c JOIN e v ON v.id = src) GROUP BY id, k)"
    return ", ".join([vec, pairs, score, coef, move])


NEG = f"SELECT src, {sc.draw_sql('src', k='j + 100')} % (SELECT count(*) FROM vert), 0.0::DOUBLE, ln((SELECT count(*) // 3 FROM vert)) FROM hop, range(3) AS n(j)"
SIZE = "(SELECT (count(*) + 2) // 3 FROM vert)"
PART_NEG = f"SELECT src, lo + {sc.draw_sql('src', k='j + 100')} % (least(lo + size, n) - lo), 0.0::DOUBLE, ln(n / 3) FROM (SELECT src, size, n, dst // size * size AS lo FROM hop, (SELECT count(*) AS n, (count(*) + 2) // 3 AS size FROM vert)), range(3) AS q(j)"
EPOCH = "SELECT e.id, e.k::INT AS k, round(x + coalesce(d, 0), 6) AS x FROM e LEFT JOIN m ON m.id = e.id AND m.k = e.k"


def exact_sql(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def first_epoch(spark, d, exact: bool):
    import math

    degree, placed, n = cp_slots(spark, d)
    positive = cut(sampling.neighbours(placed, degree))
    negative = sampling.negatives(positive.select(F.col("src").alias("id")), n, 3)
    samples = train.samples_of(positive, negative, math.log(n), math.log(n // 3))
    return long_form(train.epoch(train.initial(spark.range(n), 4), samples, 0.025, 4, exact))


def long_form(emb: DataFrame) -> DataFrame:
    return emb.select("id", F.posexplode("vec").alias("k", "x")).select("id", "k", F.round("x", 6).alias("x"))


@query(EPOCH, "hop", epoch_sql(sc.table_sigmoid_sql, NEG))
def t_one_epoch(spark, d):
    return first_epoch(spark, d, False)


@query(EPOCH, "hop", epoch_sql(exact_sql, NEG))
def t_one_epoch_exact(spark, d):
    return first_epoch(spark, d, True)


@query(EPOCH, "hop", epoch_sql(sc.table_sigmoid_sql, PART_NEG))
def t_part_pair_epoch(spark, d):
    import math

    degree, placed, n = cp_slots(spark, d)
    positive = cut(sampling.neighbours(placed, degree))
    return long_form(train.part_pair_epoch(train.initial(spark.range(n), 4), positive, n, 3, 3, 0.025, 4, math.log(n), math.log(n / 3)))


@query()
def t_embed_spread(spark, d):
    """An epoch of each level without one-task training, so the distributed plan itself."""
    emb, _ = train.embed(tables.part_supplier(spark, d), EmbedConfig(epochs=1, dimension=16, scale_epochs=False), task_cells=0)
    return emb


@query()
def t_embed(spark, d):
    emb, _ = train.embed(tables.part_supplier(spark, d), EmbedConfig(epochs=6, dimension=16))
    return emb


@query(
    "SELECT alpha::DOUBLE AS alpha, sm, neg, lr::DOUBLE AS lr, bloom FROM (VALUES (0.0), (0.5), (0.75)) AS a(alpha), (VALUES (0), (1)) AS s(sm), (VALUES (1), (2), (3)) AS n(neg), (VALUES (0.025), (0.00625), (0.1)) AS l(lr), (VALUES (0), (1)) AS b(bloom) WHERE NOT (sm = 1 AND alpha <> 0)",
)
def x_grid(spark, d):
    return spark.createDataFrame(parameter_grid(), "alpha double, sm int, neg int, lr double, bloom int")
