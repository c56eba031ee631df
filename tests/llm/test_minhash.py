import random
from collections import Counter

import numpy as np

from weftgraph.llm import bagminhash
from weftgraph.llm.common import mix


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def by_brute_force(rows):
    """doc_id -> (class, links) with all pairs compared."""
    bags = [bag(t) for _, t in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and sum((a & bags[j]).values()) >= 0.8 * sum((a | bags[j]).values()):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, ahead = {i}, [i]
        while ahead:
            ahead = [j for a in ahead for j in near[a] if j not in seen and not seen.add(j)]
        out.append((k, min(rows[j][0] for j in seen), len(near[i])))
    return sorted(out)


def test_signatures_are_unbiased():
    draw, errors = np.random.default_rng(0), []
    for trial in range(40):
        n = draw.integers(30, 300)
        a = draw.integers(0, 6, n)
        b = np.where(draw.random(n) < 0.8, a, draw.integers(0, 6, n))
        if trial % 3 == 0:
            a, b = a * 37, b * 37 + draw.integers(0, 5, n)
        key = mix(draw.integers(1, 2**62, n).astype(np.uint64))
        rows = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = bagminhash.signatures(rows, np.concatenate([key[a > 0], key[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1000)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.02


def test_classes_by_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    base = [[f"w{draw.randrange(5000)}" for _ in range(draw.choice([6, 40, 150]))] for _ in range(30)]
    rows = []
    for i in range(420):
        words = list(base[i % 30] if i % 3 else base[0])
        for _ in range(draw.choice([0, 0, 1, 3])):
            words[draw.randrange(len(words))] = f"x{draw.randrange(9)}"
        rows.append((i, " ".join(words + words[:8] * draw.choice([0, 0, 5]))))
    rows += [(500, "a b"), (501, "a  b"), (502, "a b c"), (503, "again " * 400), (504, "again " * 330), (505, "again " * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = bagminhash.classes(df).collect()
    want = by_brute_force(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want
    for name, size in (("BUCKET_BLOCK", 7), ("GROUP_BLOCK", 5), ("MATRIX_CELLS", 300)):
        monkeypatch.setattr(bagminhash, name, size)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in bagminhash.classes(df).collect()) == want
    monkeypatch.setattr(bagminhash, "BLOCK_BYTES", 20_000)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in bagminhash.classes(df).collect()) == want
    kept = bagminhash.deduplicate(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want}) and kept.columns == df.columns


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, None), (2, ""), (3, long), (4, long + " end"), (5, "a b c d e"), (5, "a b c d e"), (5, "other words of an id met before")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in bagminhash.classes(df).collect()), key=str)
    assert got == sorted([(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (5, 5, 1), (5, 5, 1), (5, 5, 0)], key=str)
    assert sorted((str(r.doc_id) for r in bagminhash.deduplicate(df).collect())) == ["1", "2", "3", "5", "5", "None", "None"]
    assert bagminhash.classes(df.limit(0)).count() == 0 and bagminhash.deduplicate(df.limit(0)).count() == 0


def test_ids_that_repeat_and_names_that_clash(spark):
    """Each text is judged in its own class, whatever other texts share its id; columns with the operator's own names stay."""
    one, two = [" ".join(f"{p}{i}" for i in range(60)) for p in "ab"]
    rows = [(7, one, 1, "x"), (7, two, 2, "y"), (7, one, 3, "x"), (8, two + " end", 4, "z"), (6, one + " end", 5, "w"), (9, "alone", 6, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int, __mark string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in bagminhash.classes(df).collect())
    assert got == sorted([(7, 6, 2), (7, 7, 1), (7, 6, 2), (8, 7, 1), (6, 6, 2), (9, 9, 0)])
    kept = bagminhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(6, one + " end"), (7, two), (9, "alone")])


def test_links_of_documents(spark):
    """All links of sf0.01 and none besides, by an index of shingles: the recall over whole documents is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in bagminhash.classes(docs).collect())
    bags = {r.doc_id: bag(r.text) for r in docs.collect()}
    owners, near = {}, {k: set() for k in bags}
    for k, b in bags.items():
        met = Counter(o for shingle in b for o in owners.get(shingle, ()))
        for o in met:
            if sum((b & bags[o]).values()) >= 0.8 * sum((b | bags[o]).values()):
                near[k].add(o)
                near[o].add(k)
        for shingle in b:
            owners.setdefault(shingle, []).append(k)
    assert sorted((k, n) for k, _, n in got) == sorted((k, len(x)) for k, x in near.items())
    label = dict(zip(bags, bags))
    moved = True
    while moved:
        fresh = {k: min([label[k], *(label[o] for o in near[k])]) for k in label}
        moved, label = fresh != label, fresh
    assert {k: c for k, c, _ in got} == label
