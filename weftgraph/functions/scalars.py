"""Scalar functions as column expressions, with the same text in SQL where a check needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the drawing function; squares of its residues fit 64 bits.
PRIME = 2147483647
# Bits of a signature and the two hash lines.
SIGNATURE_BITS, HASHES = 128, ((37, 1013), (151, 229))
# Cells and bounds of the sigmoid table.
CELLS, BOUND = 1024, 6.0


def draw(ident: Column, epoch: int | Column = 0, k: int | Column = 0, seed: int = 0) -> Column:
    """A whole number in [0, PRIME) fixed by its arguments: a linear key and two quadratic rounds."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(int(x))
    h = (ident * F.lit(48271) + lit(epoch) * F.lit(69621) + lit(k) * F.lit(16807) + F.lit(seed)) % PRIME
    for _ in range(2):
        h = (h * h + (h * F.lit(48271)) % PRIME + F.lit(12345)) % PRIME
    return h


def draw_sql(ident: str, epoch: str = "0", k: str = "0", seed: int = 0) -> str:
    h = f"((({ident})::BIGINT * 48271 + ({epoch})::BIGINT * 69621 + ({k})::BIGINT * 16807 + {seed}) % {PRIME})"
    for _ in range(2):
        h = f"(({h} * {h} + ({h} * 48271) % {PRIME} + 12345) % {PRIME})"
    return h


def fraction(drawn: Column) -> Column:
    return drawn.cast("double") / F.lit(float(PRIME))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def table_sigmoid(x: Column) -> Column:
    """The logistic function at the left edge of x's cell; 1 from BOUND on, 0 below -BOUND."""
    cell = 2 * BOUND / CELLS
    return F.when(x >= BOUND, 1.0).when(x < -BOUND, 0.0).otherwise(logistic(F.lit(-BOUND) + F.floor((x + BOUND) / cell) * cell))


def table_sigmoid_sql(x: str) -> str:
    cell = 2 * BOUND / CELLS
    return f"(CASE WHEN {x} >= {BOUND} THEN 1.0 WHEN {x} < -{BOUND} THEN 0.0 ELSE 1 / (1 + exp(-(-{BOUND} + floor(({x} + {BOUND}) / {cell}) * {cell}))) END)"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def positive_bias(n: float | Column) -> Column:
    return F.ln(n if isinstance(n, Column) else F.lit(float(n)))


def negative_bias(n: Column, samples: int, whole: bool = True) -> Column:
    """ln(n / samples): whole division in memory, real division for part pairs; at least 0."""
    share = F.floor(n / samples) if whole else n / samples
    return F.ln(F.greatest(share, F.lit(1)))


def level_rate(rate: Column, n: Column, reference: int = 100_000) -> Column:
    return F.when(n > reference, rate / F.sqrt(F.floor(n / reference))).otherwise(rate)


def decayed_rate(rate: Column, epoch: Column, epochs: Column) -> Column:
    return F.greatest(1 - epoch / epochs, F.lit(1e-4)) * rate


def scaled_epochs(epochs: Column, arcs: Column, n: Column) -> Column:
    return F.floor(epochs * arcs / n / 2)


def match_cap(level: Column, n0: Column, ratio: int = 400) -> Column:
    return level * level * F.floor(n0 / ratio)


def pretty_bytes(n: int) -> str:
    """n in the largest unit of 1024s that leaves at least one, with one decimal from KB on."""
    units, x, k = ["B", "KB", "MB", "GB", "TB", "PB"], float(n), 0
    while x >= 1024 and k < len(units) - 1:
        x, k = x / 1024, k + 1
    return f"{x:.1f} {units[k]}" if k else f"{n} B"
