"""Language identification by Bayesian fusion of evidence (operator 10).

log p(language | row) = text likelihood + declared language + address suffix + host prior, up to a constant. The text
likelihood is naive Bayes over hashed runs of letters, learned from a sample of the rows of each language; the
declared language counts with its measured reliability; a suffix counts as the languages met under it; a host's prior
is its own counts smoothed towards its domain's, and those towards all rows', from one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows, bytes_of, chunks, cut, fresh_name, small_enough, tidy
from weftgraph.llm.quality import row_sums

#: Rows with a language that training sees, about: an equal share for each language, but at least LEAST_SHARE or all its rows.
TRAIN_ROWS, LEAST_SHARE = 4000, 50
#: Hashed runs of three letters.
BUCKETS = 1 << 16
#: A text's likelihood counts as if it had at most so many independent runs.
INDEPENDENT = 100.0
#: Trust in a declared language: the share of rows whose declaration is right.
TRUST = 0.9
#: Rows that a host's, or a domain's, own counts weigh as its parent's.
SMOOTHING = 20.0
#: Least posterior of an accepted row, and least runs of letters.
LEAST_POSTERIOR, LEAST_RUNS = 0.5, 1
#: Hosts and domains are broadcast up to so many, else joined by a shuffle.
BROADCAST_HOSTS = 100_000

_LETTER = np.zeros(256, np.uint8)
_LETTER[list(range(97, 123))] = range(97, 123)
_LETTER[list(range(65, 91))] = range(97, 123)
_LETTER[128:] = range(128, 256)


def runs_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row offsets) of the runs of three bytes in each row; letters count in lower case, all else as one space."""
    n = len(at) - 1
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    c = _LETTER[data].astype(np.uint32)
    run = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    run = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = (c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0))
    for k in (1, 2):
        edge = at[1:] - k
        inside[edge[(edge >= 0) & (edge < len(inside))]] = False
    kept = np.flatnonzero(inside)
    return ((run[kept] >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int64), np.searchsorted(kept, at)


@dataclass
class Model:
    languages: list[str]
    #: log p(bucket | language), buckets by languages.
    table: np.ndarray

    def likelihoods(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods, runs) of each row, damped to INDEPENDENT runs and relative to the best language."""
        bucket, ends = runs_of(data, at)
        n = np.diff(ends)
        out = np.stack([row_sums(self.table[:, k][bucket], ends) for k in range(len(self.languages))], 1)
        out = out / np.maximum(n, 1)[:, None] * np.minimum(n, INDEPENDENT)[:, None]
        return out - out.max(1, keepdims=True), n


def train(df: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Naive Bayes over all languages of df, from about `rows` rows; runs are counted on the executors, by language. None without any.

    A language's training rows are those whose hash is under the cutoff that its count over all rows asks for.
    """
    marked = df.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("k")).where("l is not null and text is not null").withColumn("h", F.xxhash64("k", "text"))
    met = marked.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "l").collect()
    if not met:
        return None
    names, share = [r["l"] for r in met], max(rows // len(met), LEAST_SHARE)
    cutoffs = {r["l"]: (1 << 63) - 1 if r["n"] <= share else max(r["least"], (share << 64) // r["n"] - (1 << 63)) for r in met}
    cutoff = df.sparkSession.createDataFrame(list(cutoffs.items()), "l string, cutoff long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            own = batch.column(0).to_pylist()
            for first, _, part, ends in chunks(data, at):
                bucket, to = runs_of(part, ends)
                for i in range(len(ends) - 1):
                    c = counts.setdefault(own[first + i], np.zeros(BUCKETS))
                    c += np.bincount(bucket[to[i] : to[i + 1]], minlength=BUCKETS) / max(1, to[i + 1] - to[i]) * min(to[i + 1] - to[i], 1000)
        for k, c in counts.items():
            yield pa.RecordBatch.from_pydict({"l": [k], "c": [c.astype(np.float32).tobytes()]})

    total = {k: np.zeros(BUCKETS) for k in names}
    # rows that repeat a text and its id count once, so they can't be more than the sample's share
    picked = marked.join(F.broadcast(cutoff), "l").where("h <= cutoff").groupBy("l", "h").agg(F.min("text").alias("text"))
    for row in picked.select("l", "text").repartition(8).mapInArrow(run, "l string, c binary").toLocalIterator():
        total[row["l"]] += np.frombuffer(row["c"], np.float32)
    share = np.stack([total[k] + 0.05 for k in names], 1)
    return Model(names, np.log(share / share.sum(0)).astype(np.float64))


def text_evidence(model: Model, text: Column) -> Column:
    """Struct of ll (log likelihood by language) and runs, worked out in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, at = bytes_of(column)
            ll, n = [], []
            for _, _, part, ends in chunks(data, at):
                a, b = model.likelihoods(part, ends)
                ll.append(a)
                n.append(b)
            flat = np.concatenate(ll).ravel() if ll else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(model.languages)), pa.int32()), pa.array(flat))
            yield pa.StructArray.from_arrays([lists, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], ["ll", "runs"])

    return F.arrow_udf(tidy(run), "struct<ll:array<double>,runs:bigint>", F.ArrowUDFType.SCALAR_ITER)(text)


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without port and user."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def declared_in(html: Column) -> Column:
    """The primary language that the markup's root element declares."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def text_of(html: Column) -> Column:
    """Markup without scripts, styles, tags and entities."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")


def at_host(host: Column, salt: Column) -> Column:
    return F.struct(host.alias("host"), salt.cast("long").alias("salt"))


def identify(df: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, least: float = LEAST_POSTERIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source", declared_col: str | None = None, suffix_col: str | None = None) -> DataFrame:
    """df and lang_id (language, null if unknown), lang_p (its posterior), lang_accepted; those names replace columns of df.

    labelled: rows to learn from (df if None), with id_col, text_col and lang_col. declared_col: the language that a row
    declares, which must not be the label that was learned from, as the text's likelihood has that already; suffix_col: the suffix of its address; host_col: its host, whose domain is what follows the first dot.
    A row is accepted if it has letters and its posterior is at least `least`. Evidence that is null, and a declared
    language that the model doesn't know, say nothing. Host and suffix counts are of the languages that texts alone favour,
    over all rows, each combined before its shuffle; a host seen once leans on its domain and on all rows.

    One row for each input row, repeated ones too; a null or empty text has no letters and isn't accepted; very long
    texts count whole, damped to INDEPENDENT runs; of languages with the same posterior the one met in most labelled
    rows is taken; an empty table, or no labelled row, gives null languages, none accepted; other columns, whatever
    their names, stay.
    """
    own = [c for c in df.columns if c not in ("lang_id", "lang_p", "lang_accepted")]
    e, host_key, prior, overall_prior, suffix_key, ratio_of, log, most = (fresh_name(df, x) for x in ("e", "host", "prior", "overall", "suffix", "ratio", "log", "max"))
    with arrow_rows(df.sparkSession, 2000):
        model = train(df if labelled is None else labelled, train_rows, id_col, text_col, lang_col)
    if model is None:
        return df.select(*own, F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("lang_p"), F.lit(False).alias("lang_accepted"))
    names, k = model.languages, len(model.languages)
    evidence = text_evidence(model, F.col(text_col).cast("string"))
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    suffix = F.col(suffix_col).cast("string") if suffix_col else F.lit(None).cast("string")
    seen = df.select(host.alias("host"), suffix.alias("suffix"), evidence.alias("e")).where(f"e.runs >= {LEAST_RUNS}")
    best = F.array_position(F.col("e.ll"), F.array_max("e.ll")).cast("int")
    counts = seen.select("host", "suffix", best.alias("b")).groupBy("host", "suffix").agg(*(F.sum((F.col("b") == i + 1).cast("long")).alias(f"c{i}") for i in range(k)))
    with arrow_rows(df.sparkSession, 2000):
        counts = cut(counts.select("host", "suffix", F.array(*(F.col(f"c{i}").cast("double") for i in range(k))).alias("c")))

    def summed(by: list[str], frame: DataFrame) -> DataFrame:
        return frame.groupBy(*by).agg(F.array(*(F.sum(F.col("c")[i]) for i in range(k))).alias("c"))

    def smoothed(own_counts: Column, parent: Column) -> Column:
        total = F.aggregate(own_counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own_counts, parent, lambda x, p: (x + SMOOTHING * p) / (total + SMOOTHING))

    overall = counts.agg(F.array(*(F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(k))).alias("g")).select(smoothed(F.col("g"), F.array(*[F.lit(1.0 / k)] * k)).alias("g"))
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"\.(.+)$", 1), F.lit("")), F.lit("."))
    hosts = summed(["host"], counts.where("host is not null")).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(k))).alias("d"))
    priors = hosts.join(domains, "domain").join(F.broadcast(overall)).select(at_host(F.col("host"), F.lit(0)).alias(host_key), smoothed(F.col("c"), smoothed(F.col("d"), F.col("g"))).alias(prior))
    if small_enough(hosts, BROADCAST_HOSTS):
        priors = F.broadcast(priors)
    # rows without a host match none, and are dealt by their text where the join is a shuffle
    wanted = at_host(host, F.when(host.isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(0))
    rows = df.select(*own).withColumn(e, evidence).join(priors, wanted == F.col(host_key), "left").join(F.broadcast(overall.select(F.col("g").alias(overall_prior))))
    log_p = F.zip_with(F.col(f"{e}.ll"), F.coalesce(prior, overall_prior), lambda a, p: a + F.ln(p))
    if suffix_col:
        suffixes = summed(["suffix"], counts.where("suffix is not null")).join(F.broadcast(overall)).select(F.col("suffix").alias(suffix_key), F.zip_with(smoothed(F.col("c"), F.col("g")), "g", lambda s, g: F.ln(s / g)).alias(ratio_of))
        rows = rows.join(F.broadcast(suffixes) if small_enough(suffixes, BROADCAST_HOSTS) else suffixes, suffix == F.col(suffix_key), "left")
        log_p = F.zip_with(log_p, F.coalesce(ratio_of, F.array(*[F.lit(0.0)] * k)), lambda a, r: a + r)
    if declared_col:
        known = F.array(*map(F.lit, names))
        said = F.lower(F.substring_index(F.col(declared_col).cast("string"), "-", 1))
        ratio = F.transform(known, lambda x: F.when(~F.array_contains(known, said) | said.isNull(), 0.0).when(x == said, float(np.log(TRUST))).otherwise(float(np.log((1 - TRUST) / max(1, k - 1)))))
        log_p = F.zip_with(log_p, ratio, lambda a, r: a + r)
    rows = rows.withColumn(log, log_p).withColumn(most, F.array_max(log))
    known = F.array(*map(F.lit, names))
    total = F.aggregate(log, F.lit(0.0), lambda a, x: a + F.exp(x - F.col(most)))
    lettered = F.col(f"{e}.runs") >= LEAST_RUNS
    found = F.when(lettered, F.element_at(known, F.array_position(log, F.col(most)).cast("int"))), F.when(lettered, 1 / total)
    return rows.select(*own, found[0].alias("lang_id"), found[1].alias("lang_p"), F.coalesce(found[1] >= least, F.lit(False)).alias("lang_accepted"))


def identify_pages(pages: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """page_id, url, lang_id, lang_p and lang_accepted of web pages: visible text, declared language, suffix and host of each.

    Null addresses and markup say nothing, a page without visible letters isn't accepted; repeated rows, long pages, empty
    tables and other columns as in identify().
    """
    host = host_of(F.col("url"))
    rows = pages.select("page_id", "url", text_of(F.col("html")).alias("text"), declared_in(F.col("html")).alias("declared"), host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))
    return identify(rows, labelled, host_col="host", declared_col="declared", suffix_col="suffix", **options).select("page_id", "url", "lang_id", "lang_p", "lang_accepted")
