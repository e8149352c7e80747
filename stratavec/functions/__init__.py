"""Scalar functions that Spark lacks, and column forms of small vector and bit operations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Inner product of two array columns, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def packed_bits(codes, bits: int, width: int) -> list[Column]:
    """The bytes of a row's codes as a little-endian stream of `bits`-bit symbols, one long column a byte."""
    total = F.lit(0).cast("long")
    for i in range(width):
        total = total + F.shiftleft(F.get(codes, F.lit(i)).cast("long"), i * bits)
    return [F.shiftright(total, 8 * b).bitwiseAND(F.lit(255).cast("long")) for b in range(-(-width * bits // 8))]


def unit_draw(seed, *columns) -> Column:
    """A number in [0, 1) from the first 32 bits of the SHA-256 of seed and columns joined by colons."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_t_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def student_t_quantile(p: float, df: float) -> float:
    """The value below which a share p of Student's t distribution lies."""
    lo, hi = -1.0, 1.0
    while student_t_cdf(lo, df) > p:
        lo *= 2
    while student_t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if student_t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees of freedom; 1 under three pairs."""
    if n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    return 2 * (1 - student_t_cdf(abs(t), n - 2))
