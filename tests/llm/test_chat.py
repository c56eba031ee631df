import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import chat

TEXT = st.text(alphabet=st.sampled_from(list("ab \\[]<>/s\né")), max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[x]\n", ""]), TEXT), max_size=6))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_same_as_sql(spark):
    d = "/root/testdata/sf0.01"
    got = chat.digest(spark.read.parquet(f"{d}/conversations.parquet")).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    db.execute(chat.ORACLE_SQL)
    assert sorted(map(tuple, got)) == sorted(db.fetchall())


def paths_by_hand(nodes):
    parent = {n: p for n, p, _ in nodes}
    score = {n: s or 0 for n, _, s in nodes}
    out = {}
    for leaf in set(parent) - set(parent.values()):
        path, n = [], leaf
        while n in parent:
            path.append(n)
            n = parent[n]
        out[leaf] = (path[::-1], sum(score[n] for n in path))
    return out


def test_trees(spark):
    nodes = [(1, None, 1.0), (2, 1, 2.0), (3, 1, 5.0), (4, 2, 1.0), (5, 2, None), (6, 99, 1.0), (7, 6, 7.0)] + [(100 + i, 99 + i if i else None, 0.0) for i in range(70)]
    df = spark.createDataFrame([("t", *x, "user", f"m{x[0]}") for x in nodes] + [("c", 1, 2, 0.0, "user", "x"), ("c", 2, 1, 0.0, "user", "y")], "tree string, node long, parent long, score double, role string, text string")
    want = paths_by_hand(nodes)
    rows = chat.leaf_paths(df).collect()
    for leaf, (path, _) in want.items():
        assert [r.node for r in sorted((r for r in rows if r.leaf == leaf), key=lambda r: r.depth)] == path
    assert {r.leaf for r in rows} == set(want)
    ranked = sorted(want, key=lambda leaf: (-want[leaf][1], leaf))
    assert [k for k, _ in sorted({(r.leaf, r["rank"]) for r in rows}, key=lambda x: x[1])] == ranked
    best = chat.format_conversations(df).collect()
    assert [(r.conv_id, r.leaf, len(chat.parse_turns(r.formatted))) for r in best] == [("t", ranked[0], len(want[ranked[0]][0]))]


def test_edges(spark):
    rows = [(1, 0, None, None, 5), (1, 0, None, None, 5), (None, None, "user", "a", 5), (None, 1, "assistant", "b", 5), (2, 7, "assistant", "x" * 50_000, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int")
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.linear_replies(df))).collect()}
    assert {k: [tuple(t) for t in r.turns] for k, r in back.items()} == {1: [("", "")] * 2, None: [("user", "a"), ("assistant", "b")], 2: [("assistant", "x" * 50_000)]}
    assert back[None].loss == "b"
    assert chat.format_conversations(chat.linear_replies(df.limit(0))).count() == 0
