"""Secret scans with corpus-wide ownership frequency (operator 6). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import cut, fresh_name, small_enough

# Kinds in the order that breaks ties, pattern, group of the credential, least characters of that group.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("opaque", r"[A-Za-z0-9_-]{20,}", 0, 20),
)
#: A credential met with so many owners, or in so many repositories, at least is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
#: What is known of credentials with so many spans at least is broadcast, up to BROADCAST_HASHES of them, and never joined by a shuffle.
HOT_SPANS, BROADCAST_HASHES = 1000, 100_000
#: Distinct characters of a live-looking credential, at least.
LEAST_DISTINCT = 6
#: What a live-looking credential becomes in redact().
MASK = "[SECRET]"
_BLOCK = 256


def sums_before(lengths: Column) -> Column:
    """Sums of all elements before each one, by blocks, so that long arrays aren't copied once for each element."""
    add = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    start = lambda at: F.struct(at.alias("s"), F.expr("cast(array() as array<int>)").alias("a"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: b * _BLOCK + 1)
    totals = F.transform(starts, lambda b: F.aggregate(F.slice(lengths, b, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))
    bases = F.aggregate(totals, start(F.lit(0)), add)["a"]
    return F.flatten(F.zip_with(starts, bases, lambda b, base: F.aggregate(F.slice(lengths, b, F.lit(_BLOCK)), start(base), add)["a"]))


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of the pattern, leftmost and non-overlapping, whose group has `least` characters; code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + g)
    at = F.zip_with(F.zip_with(sums_before(both), gaps, lambda s, g: s + g), F.arrays_zip(found.alias("m"), value.alias("v")), lambda s, x: F.struct(s.alias("s"), x["m"].alias("m"), x["v"].alias("v")))
    spans = F.transform(F.filter(at, lambda x: x["m"].isNotNull()), lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(spans, lambda x: F.length(x["value"]) >= least)).otherwise(F.lit(None).cast(_SPAN))


def row_key(*columns: Column) -> Column:
    """Two hashes of 64 bits, by unlike seeds, of a row's columns, nulls told apart: equal for equal rows only, at any size of corpus."""
    missing = [c.isNull() for c in columns]
    return F.struct(F.xxhash64(*columns, *missing).alias("a"), F.xxhash64(F.lit("second"), *columns, *missing).alias("b"))


def scan(df: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """doc_id, key, repo, owner, base and more: base spans by start and kind, and opaque strings apart from them, of each row's whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"),
    ).withColumn("key", row_key(F.col("doc_id"), F.col("repo"), F.col("owner"), F.col("text")))
    empty = F.lit(None).cast(_SPAN)
    for rank, kind in enumerate(KINDS):
        rows = rows.withColumn(kind[0], F.coalesce(spans_of(F.col("text"), rank, *kind), F.expr(f"cast(array() as {_SPAN})"), empty))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(F.col(k[0]) for k in KINDS[:3]))))
    more = F.filter("opaque", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("doc_id", "key", "repo", "owner", "base", more.alias("more"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, repos, owners, n: distinct repositories and owners, and spans, of each credential.

    Counting goes by (hash, side, who), then by hash, each combined before its shuffle, so a credential in a third of
    all rows meets no hot task. A null repository or owner is one of its own.
    """
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("who")) for side in ("repo", "owner")))
    by_side = spans.select("hash", F.explode(sides).alias("x")).groupBy("hash", "x.side", "x.who").agg(F.count("*").alias("n"))
    is_repo = F.col("side") == "repo"
    return by_side.groupBy("hash").agg(F.sum(is_repo.cast("long")).alias("repos"), F.sum((~is_repo).cast("long")).alias("owners"), F.sum(F.when(is_repo, F.col("n"))).alias("n"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id, key and spans: structs of start, rank, kind, end, value, repos, owners, live, by start and kind.

    Base spans (assign, access, hex) always stay. A candidate's credential is hashed, and its distinct repositories and
    owners are counted over the whole corpus: with under `example_owners` owners, under `example_repos` repositories
    (so an example that one owner copies everywhere is told apart too) and LEAST_DISTINCT different characters it is
    live, else a copied example or a placeholder. An opaque string (20 or more letters, digits, - and _, with both) that
    overlaps no base span is a span only if it is live. What is known of frequent credentials is broadcast, so their
    spans aren't shuffled; see ownership() for the counts.

    One row for each input row; null ids stay, null texts are empty, a null owner or repository is one of its own, very
    long texts are scanned whole, repeated rows count as one repository, an empty table gives none, other columns,
    whatever their names, are left out. key tells unlike rows apart.
    """
    rows = cut(scan(df, id_col, text_col, repo_col, owner_col))
    spans = rows.where("size(base) + size(more) > 0").dropDuplicates(["key"])
    spans = spans.select("key", "repo", "owner", F.explode(F.concat("base", "more")).alias("span")).withColumn("hash", F.md5("span.value"))
    owned = cut(ownership(spans))
    hot = owned.where(F.col("n") >= HOT_SPANS)
    if small_enough(hot, BROADCAST_HASHES):
        rare = spans.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(owned.where(F.col("n") < HOT_SPANS), "hash")
        known = spans.join(F.broadcast(hot), "hash").unionByName(rare)
    else:
        known = spans.join(owned, "hash")
    varied = F.size(F.array_distinct(F.split("span.value", ""))) >= LEAST_DISTINCT
    judged = known.withColumn("live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos) & varied)
    judged = judged.where((F.col("span.rank") < 3) | F.col("live"))
    fields = ["span.start", "span.rank", "span.kind", "span.end", "span.value", "repos", "owners", "live"]
    by_row = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int,value:string,repos:bigint,owners:bigint,live:boolean>>)")
    return rows.select("doc_id", "key").join(by_row, "key", "left").select("doc_id", "key", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def digest(found: DataFrame) -> DataFrame:
    """What a scan found, in a line for each document."""
    base = F.filter("spans", lambda x: x["rank"] < 3)
    kinds = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) n_{k}") for k, *_ in KINDS[:3]]
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *kinds, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), live)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """df with each live-looking credential's span in the text replaced by MASK (overlapping spans by one); other rows and columns as they are.

    Nulls, long texts, repeated rows and empty tables as in find_secrets(): a null text stays null, repeated rows are
    masked alike, an empty table stays empty; columns of any names stay.
    """
    key, spans = fresh_name(df, "key"), fresh_name(df, "live")
    found = find_secrets(df, id_col, text_col, repo_col, owner_col)
    live = found.select(F.col("key").alias(key), F.filter("spans", lambda x: x["live"]).alias(spans)).where(F.size(spans) > 0).groupBy(key).agg(F.first(spans).alias(spans))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.withColumn(key, row_key(F.col(id_col).cast("long"), F.col(repo_col).cast("string"), F.col(owner_col).cast("string"), text))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK)))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substr(text, acc["at"] + 1, F.length(text))))
    return keyed.join(live, key, "left").withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(done)).select(*df.columns)


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    rx = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {rx}) AS m, regexp_extract_all(text, {rx}, {group}) AS v, string_split_regex(text, {rx}) AS gaps FROM d WHERE regexp_matches(text, {rx})"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_kind_sql(k, *kind) for k, kind in enumerate(KINDS))}),
listed AS (SELECT doc_id, source, rank, kind, least, m, v, list_transform(gaps, lambda x: length(x)) AS g, list_transform(m, lambda x: length(x)) AS n, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, source, rank, kind, start, start + length(m[i]) AS stop, v[i] AS value FROM (
  SELECT *, coalesce(list_sum(g[1:i]), 0)::BIGINT + coalesce(list_sum(n[1:i-1]), 0)::BIGINT AS start FROM listed) WHERE length(v[i]) >= least),
candidates AS (SELECT * FROM spans s WHERE rank < 3 OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.rank < 3 AND b.start < s.stop AND s.start < b.stop)),
owned AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT doc_id) AS repos FROM candidates GROUP BY value),
judged AS (SELECT c.*, owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS} AND len(list_distinct(string_split(value, ''))) >= {LEAST_DISTINCT} AS live FROM candidates c JOIN owned USING (value)),
kept AS (SELECT doc_id, rank, start, live, kind || ':' || start || ':' || stop AS line FROM judged WHERE rank < 3 OR live)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(line, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(line, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (live) AS n_live
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""
