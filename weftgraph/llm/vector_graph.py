"""Near-duplicate vectors through a robust-pruned flat graph (operator 7)."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import cut
from weftgraph.operators.components import connected_components

#: Least cosine of a link.
THRESHOLD = 0.95
#: Distinct vectors that a shard has at home on average, and nodes of a shard at most before it is split.
SHARD_ROWS, SHARD_MOST = 1500, 12_000
#: Visits of a vector's sketch to other shards on average at most, and the cosine from which centroids share a shard.
MOST_VISITS, NEAR_CENTROIDS = 8, 0.9
#: Rows that centroids are learned from at most, and centroids at most.
SAMPLE_ROWS, MOST_CENTROIDS = 20_000, 4096
#: Neighbours looked at for each node, edges kept by pruning, random nodes offered for long edges, and the factor of pruning.
CANDIDATES, DEGREE, RANDOM, ALPHA = 64, 20, 8, 1.2
#: Edges of a node in a shard at most: one that the reverses of others' edges bring over that is pruned again.
MOST_DEGREE = 2 * DEGREE
#: Edges to a node under which the chain of a hub that was pruned again takes it up.
LEAST_EDGES = DEGREE
#: Least share of the links found by brute force that the audit of a search accepts.
LEAST_RECALL = 0.9
#: Blocks of about 2,000 queries that the audit asks at most.
AUDIT_BLOCKS = 2
#: How far under the threshold a walk still follows edges.
SLACK = 0.04
_BLOCK = 256
#: Bits of a row's role in a shard: a node of its graph, a node at home (links are counted to these), a query.
NODE, HOME, QUERY = 1, 2, 4
#: A walk that has met more than one in so many of a block's pairs gives way to direct products, which are then cheaper.
DENSE = 64


def unit_rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length."""
    x = column.values.slice(column.offsets[0].as_py()).to_numpy(zero_copy_only=False)[: column.offsets[-1].as_py() - column.offsets[0].as_py()].reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; starts from rows spread over x."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def pruned_edges(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of a graph over the rows of x: each node's nearest and some random nodes, robustly pruned, and the edges' reverses.

    Pruning takes the nearest candidate, drops those that are ALPHA times nearer to it than to the node, and goes on.
    Nodes that the reverses bring over MOST_DEGREE edges are pruned again, so hubs have no more than others, and a chain of
    what a hub lets go keeps it within reach.
    """
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    draw, source, target = np.random.default_rng(seed), [], []
    k = min(CANDIDATES, n - 1)
    for i in range(0, n, _BLOCK):
        own = np.arange(i, min(n, i + _BLOCK))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        cand = np.concatenate([near, draw.integers(0, n, (len(own), RANDOM))], 1)
        dist = 1 - np.take_along_axis(sim, cand, 1)
        dist[cand == own[:, None]] = np.inf
        there = x[cand]
        among = np.matmul(there, there.transpose(0, 2, 1))
        for _ in range(DEGREE):
            best = dist.argmin(1)
            rows = np.flatnonzero(np.isfinite(dist[np.arange(len(own)), best]))
            if not len(rows):
                break
            picked = cand[rows, best[rows]]
            source.append(own[rows])
            target.append(picked)
            apart = 1 - among[rows, best[rows]]
            block = dist[rows]
            block[ALPHA * apart <= block] = np.inf
            block[np.arange(len(rows)), best[rows]] = np.inf
            dist[rows] = block
    a, b = np.concatenate(source), np.concatenate(target)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    cuts = np.searchsorted(a, np.arange(n + 1))
    hubs, lost = [], []
    for node in np.flatnonzero(np.diff(cuts) > MOST_DEGREE - 2):
        own = np.arange(cuts[node], cuts[node + 1])
        gone = np.setdiff1d(own, own[robust(x, node, b[own])])
        hubs.append(np.full(len(gone), node))
        lost.append(b[gone])
        b[gone] = -1
    a, b = a[b >= 0], b[b >= 0]
    if not hubs:
        return a, b
    # whom hubs let go may have few edges to them left: they hang on their nearest hub, one behind the other
    hub, node = np.concatenate(hubs), np.concatenate(lost)
    few = np.bincount(b, minlength=n)[node] < LEAST_EDGES
    hub, node = hub[few], node[few]
    dist = 1 - np.einsum("pd,pd->p", x[hub], x[node])
    order = np.lexsort((dist, node))
    order = order[np.diff(node[order], prepend=-1) > 0]
    order = order[np.lexsort((dist[order], hub[order]))]
    hub, node = hub[order], node[order]
    before = np.where(np.diff(hub, prepend=-1) > 0, hub, np.roll(node, 1))
    both = np.unique(np.concatenate([a * n + b, before * n + node]))
    return both // n, both % n


def robust(x: np.ndarray, node: int, cand: np.ndarray) -> list[int]:
    """Places of the candidates that pruning keeps for a node, DEGREE of them at most."""
    dist, kept = 1 - x[cand] @ x[node], []
    while len(kept) < DEGREE and np.isfinite(dist).any():
        best = int(dist.argmin())
        kept.append(best)
        dist[ALPHA * (1 - x[cand] @ x[cand[best]]) <= dist] = np.inf
        dist[best] = np.inf
    return kept


def padded(adjacency: list[np.ndarray]) -> np.ndarray:
    """Lists of neighbours as one matrix, -1 where there is none."""
    out = np.full((len(adjacency), max([1, *map(len, adjacency)])), -1, np.int64)
    for i, row in enumerate(adjacency):
        out[i, : len(row)] = row
    return out


def products(x: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes with cosine >= threshold, by the cosines of all."""
    return np.nonzero(q @ x.T >= threshold)


def in_range(x: np.ndarray, edges: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the nodes with cosine >= threshold, for queries that are the nodes `own`: a walk from each query's own node, greedily on through what is in range.

    Where that meets many pairs, all are worked out directly.
    """
    n, q = len(x), x[own]
    at = np.arange(len(own)) * n + own
    seen = np.zeros(len(own) * n, bool)
    seen[at] = True
    found, met = [at], len(at)
    while len(at):
        if met * DENSE > len(own) * n:
            return products(x, q, threshold)
        ahead = []
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            to = edges[part % n]
            flat = ((part // n)[:, None] * n + to)[to >= 0]
            flat = np.unique(flat[~seen[flat]])
            seen[flat] = True
            s = np.concatenate([np.einsum("pd,pd->p", q[f // n], x[f % n]) for f in (flat[j : j + 20_000] for j in range(0, len(flat), 20_000))] or [np.zeros(0)])
            found.append(flat[s >= threshold])
            ahead.append(flat[s >= threshold - SLACK])
        at = np.concatenate(ahead)
        met += len(at)
    both = np.concatenate(found)
    return both // n, both % n


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (least indexes) of the forest `label` after joining each a with its b."""
    while True:
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        ra, rb = label[a], label[b]
        if (ra == rb).all():
            return label
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


_VECTOR = "array<double>"


def usable(vec: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    big = F.array_max(F.transform(vec, F.abs))
    return F.coalesce(~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (big > 0), F.lit(False))


def search_graph(shards: DataFrame, threshold: float) -> DataFrame:
    """node, links, label: for each query of a shard the copies in range at home there; and, with links null, each node with the least node its shard joins it to. shards: shard, part, block, node, n, role, vec.

    Queries that are nodes walk the shard's graph from their own nodes, as a walk from elsewhere need not come to a small
    group that is far from all else; those that are nodes of another part are multiplied with the nodes at home.
    """

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        ids, role, copies = table["node"].to_numpy(), table["role"].to_numpy(), table["n"].to_numpy()
        x_all = unit_rows(table["vec"].chunk(0))
        nodes, home = np.flatnonzero(role & NODE), np.flatnonzero(role & HOME)
        own, guests = np.flatnonzero(role & (NODE | QUERY) == NODE | QUERY), np.flatnonzero(role & (NODE | QUERY) == QUERY)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def found(block: np.ndarray, row: np.ndarray, node: np.ndarray) -> None:
            nonlocal label
            keep = block[row] != node
            row, node = row[keep], node[keep]
            links[block] = np.bincount(row, copies[node], minlength=len(block)).astype(np.int64)
            label = joined_labels(label, block[row], node)

        if len(own):
            x, inside = x_all[nodes], role[nodes] & HOME > 0
            a, b = pruned_edges(x, int(ids[0]) & 0x7FFFFFFF)
            cuts = np.searchsorted(a, np.arange(len(nodes) + 1))
            matrix = padded([b[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])
            for i in range(0, len(own), _BLOCK):
                block = own[i : i + _BLOCK]
                row, node = in_range(x, matrix, np.searchsorted(nodes, block), threshold)
                found(block, row[inside[node]], nodes[node[inside[node]]])
        if len(home):
            x = x_all[home]
            for i in range(0, len(guests), _BLOCK):
                block = guests[i : i + _BLOCK]
                row, node = products(x, x_all[block], threshold)
                found(block, row, home[node])
        linked, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"node": np.concatenate([ids[linked], ids[moved]]), "links": pa.array([*links[linked].tolist(), *[None] * len(moved)], pa.int64()), "label": pa.array([*[None] * len(linked), *ids[label[moved]].tolist()], pa.int64())})

    return shards.groupBy("shard", "part", "block").applyInArrow(search, "node long, links long, label long")


def visits(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home (nearest centroid) of each row of x, and whether it visits each centroid.

    The nodes at home with a centroid are nearer to it than to any other, so they lie beyond the plane that is equally
    far from that centroid and the row's own. A row whose distance to the plane is over `reach` doesn't visit; with the
    sine of the threshold's angle as reach, none of its links are there.
    """
    sim = x @ c.T
    home = sim.argmax(1)
    size = (c * c).sum(1)
    apart = np.sqrt(np.maximum(size[home][:, None] + size - 2 * (c[home] @ c.T), 0))
    return home, sim[np.arange(len(x)), home][:, None] - sim <= reach * apart + 1e-7


def learned(sample: list[list[float]], rows: int, shard_rows: int, most_visits: float, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids of vectors of one length, the shard of each, and the reach of visits.

    Centroids that are near each other are one shard, or a large group would be cut into many. The reach is exact if
    rows of the sample visit no more than most_visits centroids of other shards with it, and is narrowed until then.
    """
    x = unit_rows(pa.array(sample, pa.list_(pa.float64())))
    c = centres(x, max(1, min(-(-rows // shard_rows), MOST_CENTROIDS, len(sample) // 4)))
    norm = np.sqrt((c * c).sum(1))
    a, b = np.nonzero(c @ c.T >= NEAR_CENTROIDS * norm[:, None] * norm)
    owner = joined_labels(np.arange(len(c)), a, b)
    if threshold <= 0:
        return c, owner, np.inf
    reach, some = np.sqrt(max(0.0, 1 - threshold * threshold)), x[:: max(1, len(x) // 1000)]
    while True:
        home, to = visits(some, c, reach)
        row, at = np.nonzero(to & (owner[home][:, None] != owner))
        if len(row) <= most_visits * len(some):
            return c, owner, reach
        reach *= 0.9


def sketches(x: np.ndarray) -> np.ndarray:
    """128 signs of random projections of each row, as two 64-bit integers."""
    planes = np.random.default_rng(7).normal(size=(x.shape[1], 128))
    return np.packbits(x @ planes > 0, axis=1).view("<i8")


def sketch_bound(threshold: float) -> float:
    """Signs in which vectors with the threshold's cosine differ: mean and four standard deviations."""
    p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return 128 * p + 4 * np.sqrt(128 * p * (1 - p))


def shard(groups: DataFrame, shard_rows: int, most_visits: float, most: int, threshold: float) -> DataFrame:
    """shard, part, block, node, n, role, vec: each vector in its home shard, and as a guest in the shards that it is invited to.

    Only sketches of vectors visit the shards that may hold links of theirs; a shard invites those whose sketch is near
    that of a vector at home. A shard of over `most` nodes or queries is dealt by hash into parts of nodes and blocks of
    queries; each part meets each block.
    """
    spark = groups.sparkSession
    sizes = {r["d"]: r["count"] for r in groups.groupBy(F.size("vec").alias("d")).count().collect()}
    share = min(1 << 20, -(-SAMPLE_ROWS * (1 << 20) * 11 // (10 * max(1, sum(sizes.values())))))
    sample = groups.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < share).select("vec").limit(SAMPLE_ROWS).toArrow().column(0).to_pylist()
    by_size = {}
    for d, n in sizes.items():
        if own := [v for v in sample if len(v) == d]:
            by_size[d] = learned(own, n, shard_rows, most_visits, threshold)
    known, bound = spark.sparkContext.broadcast(by_size), sketch_bound(threshold)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(1)])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for i in range(0, len(at), _BLOCK):
                    part = batch.take(pa.array(at[i : i + _BLOCK]))
                    x = unit_rows(part.column(1))
                    if d in known.value:
                        c, owner, reach = known.value[int(d)]
                        home, to = visits(x, c, reach)
                        to[np.arange(len(x)), home] = True
                        home = owner[home]
                    else:
                        home, to, owner = np.zeros(len(x), np.int64), np.ones((len(x), 1), bool), np.zeros(1, np.int64)
                    row, at_centroid = np.nonzero(to)
                    row, where = np.divmod(np.unique(row * MOST_CENTROIDS + owner[at_centroid]), MOST_CENTROIDS)
                    signs = sketches(x)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(where + int(d) * MOST_CENTROIDS, pa.int64()), part.column(0).take(pa.array(row)), pa.array(home[row] == where), pa.array(signs[:, 0]), pa.array(signs[:, 1])], ["shard", "node", "home", "s", "t"])

    def invite(table: pa.Table) -> pa.Table:
        ids, home = table["node"].to_numpy(), table["home"].to_numpy()
        signs = np.stack([table[k].to_numpy() for k in ("s", "t")]).view(np.uint64)
        at, ahead = np.flatnonzero(home), np.flatnonzero(~home)
        near, step = [at], max(1, (1 << 22) // max(1, len(at)))
        for i in range(0, len(ahead), step):
            block = ahead[i : i + step]
            apart = sum(np.bitwise_count(s[block][:, None] ^ s[at]).astype(np.uint16) for s in signs)
            near.append(block[(apart <= bound).any(1)])
        near = np.concatenate(near)
        return pa.table({"shard": table["shard"].take(pa.array(near)), "node": ids[near], "home": home[near]})

    visiting = groups.select("node", "vec").mapInArrow(visit, "shard long, node long, home boolean, s long, t long")
    invited = cut(visiting.groupBy("shard").applyInArrow(invite, "shard long, node long, home boolean"))
    free_shuffles(spark)
    parts = F.ceil(F.count("*") / most).cast("int")
    large = invited.groupBy("shard").agg(parts.alias("parts")).where("parts > 1")
    split = invited.join(F.broadcast(large), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("p", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    # a node is in its part for every block, and in its block for every part
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.array_union(F.transform(every, lambda b: F.struct(F.col("p").alias("part"), b.alias("block"))), F.transform(every, lambda p: F.struct(p.alias("part"), F.col("b").alias("block"))))
    split = split.withColumn("cell", F.explode(cells))
    role = F.when(F.col("cell.part") == F.col("p"), F.when(F.col("home"), NODE | HOME).otherwise(NODE)).otherwise(0) + F.when(F.col("cell.block") == F.col("b"), QUERY).otherwise(0)
    return split.select("shard", "cell.part", "cell.block", "node", role.cast("long").alias("role")).join(groups.select("node", "n", "vec"), "node")


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of what is no longer referred to deleted, which else waits until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, most_visits: float = MOST_VISITS, most: int = SHARD_MOST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links to other rows with a cosine of at least `threshold`.

    Equal vectors are one node with a count of copies. Nodes go into shards of their nearest centroids (learned from
    SAMPLE_ROWS rows); sketches visit the other shards that may hold a link (see learned()), and vectors follow where
    they are invited, so shards overlap. Each shard builds its robust-pruned graph, and each of its nodes is searched
    from its own place greedily on through all nodes in range; a link is counted where its other node is at home, so
    once. Every link is verified by its cosine in double precision. Shards return counts and a spanning forest, never
    pairs; components follow from the forests. recall() audits the search. Vectors move as they are stored, three times.

    One row for each input row. Null, zero, empty or non-finite vectors and those with null components, and rows
    without an id, have 0 links and are their own component, kept; repeated rows are other rows and link; vectors of
    unlike lengths don't; an empty table gives none; other columns are left out.
    """
    kind = df.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col).cast(kind if kind == "array<float>" else _VECTOR)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col).isNotNull() & usable(vec), vec).alias("vec"))
    keys = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    groups = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("node0"), F.count("*").alias("n"))
    groups = cut(groups.select(F.monotonically_increasing_id().alias("node"), "node0", "n", *keys, "vec"))
    free_shuffles(df.sparkSession)
    found = cut(search_graph(shard(groups, shard_rows, most_visits, most, threshold), threshold))
    free_shuffles(df.sparkSession)
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("label is not null").select(F.col("node").alias("a"), F.col("label").alias("b")))
    judged = cut(groups.drop("vec").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    judged = judged.join(judged.groupBy("component").agg(F.min("node0").alias("least")), "component")
    judged = judged.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("least").alias("component"))
    out = rows.where("vec is not null").select("vec_id", *keys).join(judged, ["k1", "k2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    # what can't link is kept out of the join, where nulls would be one key
    out = out.unionByName(rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(df: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 50, block: int = 2000, most_blocks: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Links found for the rows whose id is divisible by `every`, over those that brute force against all rows finds; queries come to the driver in blocks of about `block`, dealt by hash, of which most_blocks at most are asked."""
    vec = F.col(vec_col).cast(_VECTOR)
    rows = df.select(F.col(id_col).cast("long").alias("k"), vec.alias("vec")).where(usable(vec) & F.col(id_col).isNotNull())
    asked = rows.where(F.col("k") % every == 0).join(found.select(F.col("vec_id").alias("k"), "n_links"), "k")
    blocks = 1 + asked.count() // block
    hit = true = 0
    for i in range(min(blocks, most_blocks or blocks)):
        part = asked.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).toArrow().to_pylist()
        if not part:
            continue

        def count(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(part), np.int64)
            for batch in batches:
                lengths = np.array([len(v) for v in batch.column(1)])
                for d in np.unique(lengths):
                    own = [j for j, r in enumerate(part) if len(r["vec"]) == d]
                    if own:
                        q = unit_rows(pa.array([part[j]["vec"] for j in own], pa.list_(pa.float64())))
                        x = unit_rows(batch.column(1).take(pa.array(np.flatnonzero(lengths == d))))
                        total[own] += (q @ x.T >= threshold).sum(1)
            yield pa.RecordBatch.from_pydict({"c": [total.tolist()]})

        sums = np.sum([r["c"] for r in rows.mapInArrow(count, "c array<long>").toArrow().to_pylist()], axis=0) - 1
        true += int(sums.sum())
        hit += sum(min(r["n_links"], int(s)) for r, s in zip(part, sums, strict=True))
    return hit / true if true else 1.0


def audited(df: DataFrame, least: float = LEAST_RECALL, **options) -> DataFrame:
    """near_vectors() of df, whose search has been audited by recall() over rows whose id is divisible by 50, AUDIT_BLOCKS of them at most as each meets all rows; RuntimeError under `least`."""
    found = cut(near_vectors(df, **options))
    got = recall(df, found, options.get("threshold", THRESHOLD), most_blocks=AUDIT_BLOCKS, id_col=options.get("id_col", "vec_id"), vec_col=options.get("vec_col", "embedding"))
    if got < least:
        raise RuntimeError(f"the search found {got:.3f} of the audited links")
    return found

