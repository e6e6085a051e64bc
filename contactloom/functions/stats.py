"""Statistical functions that Spark SQL lacks, as plain functions and Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def rank_sum(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """z and two-sided p of the rank-sum test: mid-ranks, normal approximation, no tie correction."""
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan, math.nan
    both = np.concatenate([x, y])
    different, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    z = (ranks[:n].sum() - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return float(z), math.erfc(abs(z) / math.sqrt(2))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def nb_cdf(x: float, size: float, prob: float) -> float:
    """Negative binomial distribution function, continuous in x."""
    return beta_share(size, x + 1, prob) if x > -1 else 0.0


def nb_fit(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """(size, prob) of the largest likelihood of values, each ``weights`` times, by Newton steps on log(size) from the moments' size."""
    x = np.asarray(x, float)
    values, inverse = np.unique(x, return_inverse=True)
    counts = np.bincount(inverse, weights, len(values)) if len(x) else np.empty(0)
    n = counts.sum()
    if not n or (mean := float((values * counts).sum() / n)) <= 0:
        return math.nan, math.nan
    var = float((counts * (values - mean) ** 2).sum() / n)
    r = mean * mean / (var - mean) if var > mean * 1.0001 else 1e4
    psi = np.vectorize(_digamma)

    def slope(s: float) -> float:
        return float((counts * (psi(values + s) - psi(s))).sum() + n * math.log(s / (s + mean)))

    t = math.log(r)
    for _ in range(40):
        g, h = slope(math.exp(t)), 1e-4
        dg = (slope(math.exp(t + h)) - slope(math.exp(t - h))) / (2 * h)
        step = -g / dg if dg < 0 else math.copysign(0.5, g)
        t = min(max(t + max(-1.0, min(1.0, step)), -12.0), 12.0)
        if abs(step) < 1e-9:
            break
    r = math.exp(t)
    return r, r / (r + mean)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def fisher(a: float, b: float, c: float, d: float) -> float:
    """Two-sided exact test of the table ((a, b), (c, d)), entries rounded up."""
    a, b, c, d = (math.ceil(v) for v in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    lg = math.lgamma
    k = np.arange(max(0, row + col - n), min(row, col) + 1)
    fixed = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)
    p = np.array([math.exp(fixed - lg(i + 1) - lg(row - i + 1) - lg(col - i + 1) - lg(n - row - col + i + 1)) for i in k.tolist()])
    return float(min(1.0, p[p <= p[a - k[0]] * (1 + 1e-7)].sum()))


def _each(f, *columns: pd.Series) -> pd.Series:
    """``f`` once for each different row of the batch; rows with a missing value give none."""
    rows = np.stack([np.asarray(c, float) for c in columns], axis=1)
    different, at = np.unique(rows, axis=0, return_inverse=True)
    values = [math.nan if np.isnan(r).any() else f(*r) for r in different]
    out = np.array(values, float)[at.ravel()] if len(rows) else np.empty(0)
    return pd.Series(out, index=columns[0].index).astype(object).where(~np.isnan(out), None)


@pandas_udf(DoubleType())
def p_of_z(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@pandas_udf(DoubleType())
def p_of_chi2(x: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)), x)


@pandas_udf(DoubleType())
def nb_tail(x: pd.Series, size: pd.Series, prob: pd.Series) -> pd.Series:
    return _each(lambda v, r, p: 1 - nb_cdf(v, r, p), x, size, prob)


@pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _each(fisher, a, b, c, d)


UDFS = {"p_of_z": p_of_z, "p_of_chi2": p_of_chi2, "nb_tail": nb_tail, "fisher_p": fisher_p}


def register(spark) -> None:
    """Makes the functions known to SQL."""
    for name, f in UDFS.items():
        spark.udf.register(name, f)
