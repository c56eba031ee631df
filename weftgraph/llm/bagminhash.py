"""BagMinHash near-duplicates: weighted-Jaccard signatures from hierarchical Poisson processes, bands, verification (operator 3).

A text is the multiset of its runs of SHINGLE words. An element of weight w owns the strips (0, 1], (1, 2], (2, 4], ... of
the weight axis up to w. Each strip has a Poisson process in time whose rate is the strip's width; a point has a slot of
the signature and a height on the discretised strip, and counts if its height is at most w. A slot's value is the time of
its first counting point, so two texts agree in a slot with the probability of their weighted Jaccard similarity. Strips
are followed only up to the time by which every slot is filled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows, bytes_of, chunks, cut, fresh_name, mix, shingles_of, small_enough, tidy, words_of
from weftgraph.operators.components import connected_components

#: Words of a shingle, and least similarity of near-duplicates.
SHINGLE, THRESHOLD = 5, 0.8
#: Slots of a signature and slots of a band. A pair at the threshold misses all bands with probability 5e-8.
SLOTS, BAND = 128, 4
#: Slots are kept as four bits, of which unlike ones agree once in 16. A pair is verified if as many agree as at the
#: threshold less five standard deviations (3e-7).
_AGREE = THRESHOLD + (1 - THRESHOLD) / 16
LEAST_AGREED = int(SLOTS * _AGREE - 5 * (SLOTS * _AGREE * (1 - _AGREE)) ** 0.5)
#: Ids to look texts up by are broadcast up to so many, else joined by a shuffle.
BROADCAST_IDS = 500_000
#: A bucket is cut into blocks of about so many nodes, but into no more than GROUP_BLOCKS of them as long as a block has no
#: more than BUCKET_MOST.
BUCKET_BLOCK, BUCKET_MOST = 250, 4000
#: A group of alike texts is cut into blocks of about so many nodes, but into no more than GROUP_BLOCKS of them, which bounds
#: the copies of a node's elements, as long as a block's elements take no more than BLOCK_BYTES.
GROUP_BLOCK, GROUP_BLOCKS, BLOCK_BYTES = 64, 24, 1 << 23
#: Cells of a matrix of nodes and elements that is multiplied at once.
MATRIX_CELLS = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multiset(rows: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, times) of the distinct shingles of each row."""
    order = np.lexsort((shingles, rows))
    r, s = rows[order], shingles[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return r[at], s[at], np.diff(np.append(at, len(r)))


def signatures(rows: np.ndarray, shingles: np.ndarray, times: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n by slots: the first counting points' times of each row's multiset; inf for rows without shingles."""
    best = np.full(n * slots, np.inf)
    strips = [(np.arange(len(rows)), 0, 1)]
    width = 1
    while len(own := np.flatnonzero(times > width)):
        strips.append((own, width, width))
        width *= 2
    element = np.concatenate([own for own, _, _ in strips])
    low = np.concatenate([np.full(len(own), a, np.int64) for own, a, _ in strips])
    rate = np.concatenate([np.full(len(own), w, np.float64) for own, _, w in strips])
    row, top = rows[element], times[element]
    state = mix(shingles[element] ^ mix(low.astype(np.uint64) * _STEP + np.uint64(1)))
    del element

    def step(at: np.ndarray) -> np.ndarray:
        state[at] = mix(state[at] + _STEP)
        return -np.log(((state[at] >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[at]

    time = step(np.arange(len(row)))
    mass = np.bincount(rows, times, minlength=n)
    limit = slots * (np.log(slots) + 3) / np.maximum(mass, 1)
    while True:
        at = np.flatnonzero(time <= limit[row])
        while len(at):
            point = mix(state[at] ^ np.uint64(0xD6E8FEB86659FD93))
            height = low[at] + 1 + ((point >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate[at]).astype(np.int64)
            hit = height <= top[at]
            slot = (point & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
            np.minimum.at(best, row[at][hit] * slots + slot[hit].astype(np.int64), time[at][hit])
            time[at] += step(at)
            at = at[time[at] <= limit[row[at]]]
        full = np.isfinite(best.reshape(n, slots)).all(1) | (mass == 0)
        if full.all():
            return best.reshape(n, slots)
        limit = np.where(full, -1, limit * 2)


def contents(rows: np.ndarray, shingles: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """A hash of 128 bits of each row's multiset."""
    out = np.zeros((n, 2), np.uint64)
    for k in range(2):
        np.add.at(out[:, k], rows, mix(shingles ^ np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64)) * times.astype(np.uint64))
    return [c.tobytes() for c in out]


def digests(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(shingles, content hash, slots packed by four bits into words, band hashes) of each row of bytes_of()."""
    n = len(at) - 1
    rows, words, _ = words_of(data, at)
    r, s, times = multiset(*shingles_of(rows, words, SHINGLE))
    count = np.bincount(r, times, minlength=n).astype(np.int64)
    value = mix(signatures(r, s, times, n).view(np.uint64))
    bands = value.reshape(n, SLOTS // BAND, BAND)
    key = np.zeros(bands.shape[:2], np.uint64)
    for k in range(BAND):
        key = mix(key * np.uint64(3) + bands[:, :, k])
    key = mix(key + np.arange(key.shape[1], dtype=np.uint64) * _STEP)
    nibble = (value & np.uint64(15)).reshape(n, SLOTS // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return count, contents(r, s, times, n), nibble.sum(2, dtype=np.uint64).view(np.int64), key.view(np.int64)


def content_of(text: Column) -> Column:
    """The content hash of a text; null without a word."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, at = bytes_of(column)
            out: list[bytes | None] = []
            for _, _, part, ends in chunks(data, at):
                rows, words, _ = words_of(part, ends)
                n, r, s, times = len(ends) - 1, *multiset(*shingles_of(rows, words, SHINGLE))
                out += [c if has else None for c, has in zip(contents(r, s, times, n), np.bincount(r, minlength=n), strict=True)]
            yield pa.array(out, pa.binary())

    return F.arrow_udf(tidy(run), "binary", F.ArrowUDFType.SCALAR_ITER)(text)


def signed(df: DataFrame) -> DataFrame:
    """k, shingles, content, slots, bands of each row of (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for first, last, part, ends in chunks(data, at):
                count, content, slots, bands = digests(part, ends)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (slots, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(count), pa.array(content, pa.binary()), *lists], ["k", "shingles", "content", "slots", "bands"])

    return df.select("k", "text").mapInArrow(tidy(run), "k long, shingles long, content binary, slots array<long>, bands array<long>")


def element_sets(df: DataFrame) -> DataFrame:
    """content, elements: the sorted hashes of (shingle, 1), (shingle, 2), ... for each row of (k, text), so that a set stands for the multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for _, _, part, ends in chunks(data, at):
                rows, words, _ = words_of(part, ends)
                r, s, times = multiset(*shingles_of(rows, words, SHINGLE))
                content = contents(r, s, times, len(ends) - 1)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                r, e = np.repeat(r, times), mix(np.repeat(s, times) + nth.astype(np.uint64) * _STEP)
                order = np.lexsort((e, r))
                cuts = np.searchsorted(r[order], np.arange(len(ends)))
                e = e[order].astype("<u8")
                yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array([e[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["content", "elements"])

    return df.select("k", "text").mapInArrow(tidy(run), "content binary, elements binary")


def agreed(a: str, b: str) -> str:
    """SQL for the number of slots in which two packed signatures agree."""
    unlike = [f"({a}[{k}] ^ {b}[{k}])" for k in range(SLOTS // 16)]
    folded = [f"bit_count(({d} | shiftrightunsigned({d}, 1) | shiftrightunsigned({d}, 2) | shiftrightunsigned({d}, 3)) & {0x1111111111111111}L)" for d in unlike]
    return f"({SLOTS} - ({' + '.join(folded)}))"


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough to be worth verifying."""
    slots = nodes.select(F.col("node").alias("a"), F.col("slots").alias("sa"))
    found = pairs.join(slots, "a").join(slots.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")
    return found.where(f"{agreed('sa', 'sb')} >= {LEAST_AGREED}").select("a", "b")


Found = list[tuple[int, int | None, int | None]]


def by_group(rows: DataFrame, group: list[str], run: Callable[[pa.Table], Found], parts: int | None = None) -> DataFrame:
    """a, b, n: what run() gives for the rows of each group. Groups are dealt out by hash and sorted; those cut by the end of an Arrow batch are put together again."""
    width = len(group)

    def made(out: Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table, last: bool) -> tuple[Found, pa.Table | None]:
            keys = np.stack([rows.column(k).to_numpy() for k in range(width)], 1)
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys))
            out: Found = []
            for lo, hi in zip(np.append(0, ends[:-1]), ends if last else ends[:-1], strict=False):
                out += run(rows.slice(int(lo), int(hi - lo)))
            return out, None if last else rows.slice(int(ends[-2]) if len(ends) > 1 else 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1] and all(held[0].column(k)[0] == batch.column(k)[-1] for k in range(width)):
                continue
            out, rest = flush(pa.Table.from_batches(held).combine_chunks(), False)
            held = rest.to_batches()
            yield made(out)
        if held:
            yield made(flush(pa.Table.from_batches(held).combine_chunks(), True)[0])

    dealt = rows.repartition(*([parts] if parts else []), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(tidy(each), "a long, b long, n long")


def slot_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.combine_chunks().flatten().to_numpy()).reshape(len(column), SLOTS // 16).view(np.uint64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing slots of each packed signature of x with each of y."""
    unlike = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] ^ y[None, :, k]
        d = (d | (d >> np.uint64(1)) | (d >> np.uint64(2)) | (d >> np.uint64(3))) & np.uint64(0x1111111111111111)
        unlike += np.bitwise_count(d)
    return SLOTS - unlike


class Forest:
    """Labels that are joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.up = {x: x for x in labels.tolist()}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def likely_forest(rows: pa.Table) -> Found:
    """Links that join the nodes of a bucket's block as its likely pairs across components do. Rows: key, qb, tb, node, component, slots, query."""
    node, component, query = (rows[c].to_numpy() for c in ("node", "component", "query"))
    slots, asked = slot_matrix(rows["slots"]), np.flatnonzero(query)
    forest, out = Forest(node), []
    for i in range(0, len(asked), 256):
        own = asked[i : i + 256]
        near = (agreement(slots[own], slots) >= LEAST_AGREED) & (component[own][:, None] != component[None, :])
        for q, t in zip(*np.nonzero(near), strict=True):
            a, b = int(node[own[q]]), int(node[t])
            if forest.join(a, b):
                out.append((min(a, b), max(a, b), None))
    return out


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the overlaps of each sorted set of the left with each of the right: a product of matrices of nodes and elements, some columns at a time."""
    if len(left) * len(right) <= 16:
        return np.array([[np.isin(p, q, assume_unique=True).sum() for q in right] for p in left])
    element, column = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    # only elements of both sides count
    both = np.zeros((2, len(element)), bool)
    both[(row >= len(left)).astype(int), column] = True
    met = both.all(0)
    row, column = row[met[column]], (np.cumsum(met) - 1)[column[met[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(left), len(right)), np.float32), max(1, MATRIX_CELLS // (len(left) + len(right)))
    for first in range(0, int(met.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        has = np.zeros((len(left) + len(right), width), np.float32)
        has[row[lo:hi], column[lo:hi] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out.round().astype(np.int64)


def linked(rows: pa.Table, threshold: float) -> Found:
    """(node, -, copies of the nodes whose overlap with it is at least the threshold) of a block pair, and (node, least node it is joined to, -). Rows: group, i, j, node, copies, block, elements."""
    node, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    elements = [np.frombuffer(x.as_py(), "<u8") for x in rows["elements"]]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return []
    size = np.array([len(x) for x in elements])
    common = shared([elements[k] for k in left], [elements[k] for k in right])
    near = common >= threshold * (size[left][:, None] + size[right][None, :] - common)
    links = np.zeros(len(node), np.int64)
    if i == j:
        np.fill_diagonal(near, False)
    else:
        links[right] += near.T @ copies[left]
    links[left] += near @ copies[right]
    label, (p, q) = np.arange(len(node)), np.nonzero(near)
    p, q = left[p], right[q]
    while not (label[p] == label[q]).all():
        np.minimum.at(label, np.maximum(label[p], label[q]), np.minimum(label[p], label[q]))
        label = label[label]
    return [(int(node[k]), None, int(links[k])) for k in np.flatnonzero(links)] + [(int(node[k]), int(node[label[k]]), None) for k in np.flatnonzero(label != np.arange(len(node)))]


def alike(crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, group: components of the nodes that share a bucket and whose signatures agree as often as LEAST_AGREED asks.

    Each node of a bucket is paired with two of it: the one that meets most nodes over all its buckets, which in a group
    of edited copies is the original, and the first in a random order. In a bucket that these stars leave in several
    components, nodes outside its first node's component are compared with all of the bucket, in blocks; a
    block returns a forest, not pairs.
    """
    met = crowded.groupBy("node").agg(F.sum("n").alias("met"))
    firsts = crowded.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("p1"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("p2"))
    crowded = cut(crowded.join(firsts, "key"))
    star = crowded.select("node", F.explode(F.array("p1", "p2")).alias("p")).where("node <> p")
    star = cut(likely(star.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), nodes))
    parts = connected_components(star)
    member = cut(crowded.select("key", "node", "p1", "n").join(parts, "node", "left").select("key", "node", "p1", "n", F.coalesce("component", "node").alias("component")))
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("node") == F.col("p1"), F.col("component"))).alias("main")).where("lo <> hi").select("key", "main")
    rows = member.join(mixed, "key").join(nodes.select("node", "slots"), "node").withColumn("query", F.col("component") != F.col("main"))
    blocks = F.greatest(F.ceil(F.col("n") / BUCKET_MOST), F.least(F.ceil(F.col("n") / BUCKET_BLOCK), F.lit(GROUP_BLOCKS))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # block (qb, tb): the queries of qb against the nodes of tb
    targets = rows.select("key", F.explode(every).alias("qb"), F.col("own").alias("tb"), "node", "component", "slots", (F.col("query") & (F.col("own") == F.col("qb"))).alias("query"))
    asking = rows.where("query and blocks > 1").select("key", F.col("own").alias("qb"), F.explode(F.filter(every, lambda b: b != F.col("own"))).alias("tb"), "node", "component", "slots", "query")
    more = by_group(targets.unionByName(asking), ["key", "qb", "tb"], likely_forest).select("a", "b")
    return connected_components(star.unionByName(more)).withColumnRenamed("component", "group")


def compared(groups: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: all pairs of each group of alike texts, compared by the overlap of their multisets; see linked().

    Blocks of a group meet in pairs, and return a count for each node and a forest, never pairs. Groups of one block, by
    far the most, go to their task whole; of the others, which are few, each block goes to as many tasks as the group
    has blocks.
    """
    member = cut(groups.join(nodes.select("node", "k", "content", "copies"), "node"))
    ids = member.select("k").distinct()
    sets = element_sets(docs.join(F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids, "k", "left_semi")).dropDuplicates(["content"])
    whole = cut(member.select("node", "group", "copies", "content").join(sets, "content").drop("content"))
    sizes = whole.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("elements")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("n") / GROUP_BLOCK), F.lit(GROUP_BLOCKS))).cast("int")
    large = cut(sizes.select("group", blocks.alias("blocks")).where("blocks > 1"))
    whole = whole.join(F.broadcast(large) if small_enough(large, BROADCAST_IDS) else large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    whole = whole.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = whole.select("group", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "node", "copies", "block", "elements")
    return cut(by_group(dealt, ["group", "i", "j"], lambda rows: linked(rows, threshold)))


def judged(df: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(k, content and shingles of each row, content null where there is none to compare; content, component, class_id and n_links of each distinct content)."""
    docs = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    usable = (F.col("shingles") > 0) & F.col("k").isNotNull()
    rows = cut(signed(docs))
    nodes = rows.where(usable).groupBy("content").agg(F.min("k").alias("k"), F.count("*").alias("copies"), F.min(F.struct("slots", "bands")).alias("x"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "content", "k", "copies", "x.slots", "x.bands"))
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    crowded = cut(buckets.join(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    found = compared(alike(crowded, nodes), nodes, docs.where("k is not null"), threshold)
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    placed = nodes.select("node", "content", "k", "copies").join(links, "node", "left").join(parts, "node", "left")
    placed = cut(placed.select("content", "k", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # cut, so that a join with it can be split where a component is large
    least = cut(placed.groupBy("component").agg(F.min("k").alias("class_id")))
    return rows.select("k", "shingles", F.when(usable, F.col("content")).alias("content")), placed.join(least, "component").select("content", "component", "class_id", "n_links")


def classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (other rows whose text overlaps by the threshold) and shingles of each row.

    1. Each text gets a content hash and a signature; equal contents become one node with a count of copies. 2. Nodes
    that share a band's hash are in a bucket; those of a bucket with likely signatures are joined to groups, see
    alike(). 3. All pairs of a group are compared by their multisets in blocks, see compared(): the links are counted,
    and the classes are their connected components. So no bucket or group is capped, and none is paired up in rows.

    One row for each input row. Rows without an id or without a word are in no class (class_id: their id, no links).
    Texts of 1 to 4 words have one shingle, so only equal ones meet. Very long texts are compared whole. Repeated rows
    stay and link with each other. Different texts with the same id are compared as different texts; classes in which
    that id is the least have the same class_id. An empty table gives none; other columns, whatever their names, are
    left out.
    """
    with arrow_rows(df.sparkSession, 1000):
        rows, contents_of = judged(df, threshold, id_col, text_col)
    bare = F.col("content").isNull()  # kept out of the join, where nulls would be one key
    alone = rows.where(bare).select(F.col("k").alias("doc_id"), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "shingles")
    return rows.where(~bare).join(contents_of, "content").select(F.col("k").alias("doc_id"), "class_id", "n_links", "shingles").unionByName(alone)


def deduplicate(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stand for their class: the one with the least id.

    Rows without an id or a word stay. Of rows that repeat both id and text, one stays; of different texts with the same
    id, each is judged in its own class. Very long texts are compared whole, an empty table gives none, and the columns
    of df, whatever their names, stay as they are.
    """
    with arrow_rows(df.sparkSession, 1000):
        rows, contents_of = judged(df, threshold, id_col, text_col)
        found = cut(rows.where(F.col("content").isNotNull()).join(contents_of, "content").select("k", "content", "component"))
    kept_of = cut(found.groupBy("component").agg(F.min(F.struct("k", "content")).alias("kept")))
    again = cut(found.groupBy("k").count().where("count > 1").select("k"))
    gone = cut(found.join(kept_of, "component").where("k <> kept.k").select("k").distinct().join(again, "k", "left_anti"))
    key, mark, text = fresh_name(df, "key"), fresh_name(df, "mark"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn(key, F.col(id_col).cast("long"))

    def of(ids: DataFrame) -> DataFrame:
        ids = ids.withColumnRenamed("k", key)
        return F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids

    out = keyed.join(of(gone), key, "left_anti")
    if not again.isEmpty():
        kept = found.join(of(again).withColumnRenamed(key, "k"), "k", "left_semi").join(kept_of, "component").where("k = kept.k and content = kept.content").select(F.col("k").alias(key), F.col("content").alias(mark)).distinct()
        some = out.join(of(again), key, "left_semi").withColumn(mark, content_of(text))
        some = some.where(F.col(mark).isNull()).unionByName(some.join(kept, [key, mark], "left_semi").dropDuplicates([key, mark]))
        out = out.join(of(again), key, "left_anti").unionByName(some.drop(mark))
    return out.select(*df.columns)
