"""Feature statistics: one-way ANOVA, F tail, entropies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anova(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """(kmer_id, ord, val) long with implicit zeros, (ord, grp) -> (kmer_id, f).

    Sums over non-zero cells and the groups' whole sizes are enough: zeros add nothing.
    A constant feature has no F (null).
    """
    sizes = samples.groupBy("grp").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("n").alias("n_all"), F.count("*").alias("groups"))
    cells = matrix.join(samples.select("ord", "grp"), "ord").groupBy("kmer_id", "grp").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q"))
    sums = cells.join(sizes, "grp").groupBy("kmer_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    one = totals.first()  # two numbers of the sample table
    n, g = one["n_all"], one["groups"]
    between = (F.col("b") - F.col("s") * F.col("s") / n) / (g - 1)
    within = (F.col("q") - F.col("b")) / (n - g)
    return sums.select("kmer_id", F.try_divide(between, within).alias("f"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(df1: float, df2: float, f: float) -> float:
    """P(F >= f)."""
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def f_critical(df1: float, df2: float, p: float) -> float:
    """The F with tail probability p, by bisection."""
    low, high = 0.0, 1.0
    while f_tail(df1, df2, high) > p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f_tail(df1, df2, middle) > p else (low, middle)
    return high


def anova_filter(matrix: DataFrame, samples: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Features whose p is not above the threshold; those without an F stay.  p <= t is F >= the critical value, so no Python runs per row."""
    n, g = samples.count(), samples.select("grp").distinct().count()
    return anova(matrix, samples).where(F.coalesce(F.col("f") >= f_critical(g - 1, n - g, threshold), F.lit(True)))


def symmetric_uncertainty(a, b) -> float:
    """2 (H(a) + H(b) - H(a, b)) / (H(a) + H(b)) of two state vectors; NaN of two constants."""
    def entropy(counts: np.ndarray) -> float:
        p = counts[counts > 0] / counts.sum()
        return float(-(p * np.log2(p)).sum())

    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    joint = np.bincount(a * (b.max() + 1) + b)
    ha, hb = entropy(np.bincount(a)), entropy(np.bincount(b))
    return 2 * (ha + hb - entropy(joint)) / (ha + hb) if ha + hb else math.nan
