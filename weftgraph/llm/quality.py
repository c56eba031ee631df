"""Quality rules and a calibrated n-gram classifier of quality (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACES, bytes_of, chunks, mix, shingles_of, words_of

#: Labelled rows that training sees at most: those whose hashed id is least.
TRAIN_ROWS = 3000
#: Hashed features of each of the two kinds.
BUCKETS = 1 << 15
#: Fixed thresholds: least words, most per cent of words in repeated windows, least calibrated probability of quality.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 50, 50, 0.3
_SCALE = 20.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i] : at[i + 1]]; a row's sum depends on its own values only."""
    out = np.zeros(len(at) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], dtype=out.dtype)
    return out


def base_rules(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counts for each row of bytes_of()."""
    n = len(at) - 1
    rows, words, _ = words_of(data, at)
    n_words = np.bincount(rows, minlength=n)
    repeated = np.zeros(len(rows), bool)
    if len(rows) >= 3:
        own = np.flatnonzero(rows[:-2] == rows[2:])
        if len(own):
            _, window = shingles_of(rows, words, 3)
            # rows shorter than a window also give one shingle each; only whole windows are compared
            whole = n_words[_shingle_rows(rows, n_words, 3)] >= 3
            window = mix(window[whole] ^ (rows[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(window, kind="stable")
            same = window[order][1:] == window[order][:-1]
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for k in range(3):
                repeated[own[twice] + k] = True
    dup = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in data[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip(SPACES)]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n_words,
        "word_chars": row_sums((~_SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int64), at),
        "n_symbols": row_sums(_SYMBOL[data].astype(np.int64), at),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(rows[repeated], minlength=n),
    }


def _shingle_rows(rows: np.ndarray, n_words: np.ndarray, size: int) -> np.ndarray:
    """The row of each shingle that shingles_of() gives."""
    return np.repeat(np.arange(len(n_words)), np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64)))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, the bytes as one number) of each character of UTF-8."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    length = np.diff(starts, append=len(data))
    value = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        value[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return starts, value


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, offsets by row): words with word pairs, then runs of three characters."""
    n = len(at) - 1
    rows, words, _ = words_of(data, at)
    pair = mix(words[:-1] * np.uint64(3) + words[1:])[rows[:-1] == rows[1:]] if len(rows) else words
    pair_rows = rows[:-1][rows[:-1] == rows[1:]] if len(rows) else rows
    all_rows = np.concatenate([rows, pair_rows])
    order = np.argsort(all_rows, kind="stable")
    bucket = (np.concatenate([words, pair]) & np.uint64(BUCKETS - 1)).astype(np.int64)[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=n))])
    starts, c = code_points(data)
    if len(c) < 3:
        return [(bucket, ends), (np.zeros(0, np.int64), np.zeros(n + 1, np.int64))]
    at = np.searchsorted(starts, at)  # from here on places of characters
    run = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    run = (run ^ (run >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    run = ((run >> np.uint32(12)) & np.uint32(BUCKETS - 1)).astype(np.int64)
    length = np.maximum(np.diff(at) - 2, 0)
    inside = np.ones(len(run), bool)
    for k in (1, 2):
        cut = at[1:] - k
        inside[cut[(cut >= 0) & (cut < len(run))]] = False
    return [(bucket, ends), (run[inside], np.concatenate([[0], np.cumsum(length)]))]


@dataclass
class Classifier:
    """p(good) = logistic(slope * score + shift); a score is the bias plus, by kind, the mean weight of a row's features."""

    weights: list[np.ndarray]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at) - 1, self.bias)
        for weight, (bucket, ends) in zip(self.weights, features(data, at), strict=True):
            out += row_sums(weight[bucket], ends) / np.maximum(np.diff(ends), 1)
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def train(rows: list[tuple[int, bytes, bytes]], steps: int = 200, decay: float = 1e-4) -> Classifier | None:
    """A classifier from (label, buckets as int32, shares as float32); every fifth row only calibrates. None without both labels."""
    held = np.array([i % 5 == 4 for i in range(len(rows))], bool)
    y = np.array([r[0] for r in rows], float)
    if len(set(y[~held])) < 2:
        return None
    bucket = [np.frombuffer(r[1], np.int32) for r in rows]
    share = [np.frombuffer(r[2], np.float32) for r in rows]
    size = np.array([len(b) for b in bucket])
    at, which = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(rows)), size)
    flat, value = np.concatenate(bucket), np.concatenate(share).astype(np.float64) * _SCALE
    fit = ~held[which]
    f_flat, f_value, f_which = flat[fit], value[fit], which[fit]
    w, b = np.zeros(2 * BUCKETS), 0.0
    m, v = np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1)
    for step in range(1, steps + 1):
        z = np.bincount(f_which, w[f_flat] * f_value, minlength=len(rows)) + b
        error = np.where(held, 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / (~held).sum()
        g = np.append(np.bincount(f_flat, error[f_which] * f_value, minlength=2 * BUCKETS) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = Classifier([w[:BUCKETS] * _SCALE, w[BUCKETS:] * _SCALE], float(b))
    z = row_sums(w[flat] * value, at) + b
    out.slope, out.shift = calibrate(z[held], y[held])
    return out


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out rows, by Newton steps on smoothed targets."""
    if len(set(y)) < 2:
        return 1.0, 0.0
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        a = a - np.clip(step, -2, 2)
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def training_rows(df: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> list[tuple[int, bytes, bytes]]:
    """At most `rows` labelled texts as features, in a fixed order; equal labels of a document count once, opposite ones cancel.

    Of rows that repeat an id one counts, that with the least text; a text has 2 * BUCKETS features at most.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("double").alias("y")).dropna()
    marked = marked.groupBy("k").agg(F.avg("y").alias("y")).where("y <> 0.5").orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked.select("k")), "k", "left_semi")
    texts = texts.groupBy("k").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).join(F.broadcast(marked), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(2))
            index, share = [], []
            for _, _, part, ends in chunks(data, at):
                made = features(part, ends)
                for i in range(len(ends) - 1):
                    both = [np.unique(bucket[e[i] : e[i + 1]], return_counts=True) for bucket, e in made]
                    index.append(np.concatenate([u + k * BUCKETS for k, (u, _) in enumerate(both)]).astype(np.int32).tobytes())
                    share.append(np.concatenate([c / max(1, c.sum()) for _, c in both]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(share, pa.binary())], ["k", "y", "i", "s"])

    found = texts.select("k", F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "k long, y int, i binary, s binary").toArrow().to_pylist()
    found.sort(key=lambda r: ((r["k"] * 2654435761) % 2**32, r["k"], r["i"]))
    return [(r["y"], r["i"], r["s"]) for r in found]


def quality_rules(df: DataFrame, labels: DataFrame, threshold: float = LEAST_PROBABILITY, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the rules' counts, base_failed, probability and kept of each row's whole text.

    A word is a run of characters other than ASCII white space. base_failed: fewer than LEAST_WORDS words, or over
    MOST_REPEATED per cent of them in repeated three-word windows. kept: not base_failed and the calibrated probability of
    quality is at least `threshold`. The classifier learns from at most train_rows labelled documents, sends 2 * BUCKETS
    weights to each task and is scored in Arrow batches. Without labels of both kinds the probability is null and the
    rules alone decide.

    One row for each input row: null ids stay null, null and empty texts have no words and fail, repeated rows stay,
    very long texts are counted and scored whole, an empty table gives none, other columns are left out. Labels that are
    null are left out.
    """
    model = train(training_rows(df, labels, train_rows, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for first, last, part, ends in chunks(data, at):
                counts = base_rules(part, ends)
                p = model.probability(model.score(part, ends)) if model else None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(p, pa.float64()) if model else pa.nulls(last - first, pa.float64())],
                    ["doc_id", *counts, "probability"],
                )

    found = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = found.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("probability") >= threshold, F.lit(True)))
