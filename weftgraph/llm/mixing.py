"""Mixing sources to target weights by Poisson replication (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh_name, small_enough, unit

#: Share of a source in the mixture: its documents to this power, over the sum of that.
POWER = 0.5
#: Documents of the mixture for each one of the input, on average.
EPOCHS = 1.0
SEED = 17
#: A source's rates are broadcast up to so many sources, else joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Rates over this are drawn as the sum of equal smaller ones, as exp(-rate) would vanish.
LARGEST_RATE = 64.0


def tempered_rates(df: DataFrame, source_col: str = "source", power: float = POWER, epochs: float = EPOCHS) -> DataFrame:
    """source, rate: the mean repetitions that bring each source to its share; a null source is a source."""
    counts = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")).withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    return counts.join(F.broadcast(total)).select("source", (F.col("weight") / F.col("all_weight") * F.col("all_n") * F.lit(float(epochs)) / F.col("n")).alias("rate"))


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... events, up to where the rest is below a double's precision."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")), start, step)["c"]


def replicate(df: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """df's rows, each as often as its source's Poisson distribution says at the row's hashed draw, in a global random order.

    Columns: those of df, then copy (1, 2, ...) and shuffle_key, replacing any of those names; rows come sorted by
    shuffle_key. rates: (source, rate); sources without a rate, or with one that is null or not over 0, get no rows. Draws
    depend on the seed and the id only, so repeated rows are repeated alike; rows without an id are drawn by their text.
    Null sources match a null source of rates. Texts, however long, go with their rows. Empty tables give none. Other
    columns, whatever their names, stay. A hot source costs nothing: rates are joined by a
    broadcast up to BROADCAST_SOURCES, else by a join whose skew adaptive execution splits, and the shuffle is by range
    of a hash.
    """
    own = [c for c in df.columns if c not in ("copy", "shuffle_key")]
    at, pieces, part_rate, cdf, key, n = (fresh_name(df, x) for x in ("source", "pieces", "rate", "cdf", "key", "n"))
    split = F.ceil(F.col("rate") / LARGEST_RATE)
    rated = rates.where(F.col("rate") > 0).select(F.col("source").alias(at), split.cast("int").alias(pieces), (F.col("rate") / split).alias(part_rate))
    rated = rated.select(at, pieces, cumulative(F.col(part_rate)).alias(cdf))
    if small_enough(rates, BROADCAST_SOURCES):
        rated = F.broadcast(rated)
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    draws = F.transform(F.sequence(F.lit(1), F.col(pieces)), lambda j: unit(F.lit(f"draw:{seed}"), F.col(key), j))
    drawn = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    rows = df.select(*own).withColumn(key, named).join(rated, F.col(source_col).eqNullSafe(F.col(at)))
    rows = rows.withColumn(n, drawn).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"place:{seed}"), F.col(key), F.col("copy"))), 1, 13), 16, 10).cast("long")
    return rows.withColumn("shuffle_key", place).select(*own, "copy", "shuffle_key").orderBy("shuffle_key", id_col, "copy")


ORACLE_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, power(count(*)::DOUBLE, {POWER}) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE * {EPOCHS} / n AS rate FROM counts),
pieces AS (SELECT source, ceil(rate / {LARGEST_RATE})::INT AS pieces, rate / ceil(rate / {LARGEST_RATE}) AS rate FROM rates),
cdf AS (
  SELECT source, pieces, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM pieces
  UNION ALL
  SELECT source, pieces, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 24)),
draws AS (
  SELECT d.doc_id, j, d.source, ('0x' || substr(md5('draw:{SEED}:' || d.doc_id || ':' || j), 1, 13))::BIGINT / {float(16**13)} AS u
  FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.pieces + 1)) AS t(j)),
copies AS (SELECT doc_id, sum(n)::INT AS n FROM (
  SELECT doc_id, j, count(*) AS n FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= draws.u GROUP BY doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.copy::INT AS copy,
  ('0x' || substr(md5('place:{SEED}:' || d.doc_id || ':' || t.copy), 1, 13))::BIGINT AS shuffle_key
FROM documents d JOIN copies c ON d.doc_id = c.doc_id, unnest(range(1, c.n + 1)) AS t(copy)
"""
