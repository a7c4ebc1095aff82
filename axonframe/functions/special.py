"""Special functions that Spark SQL lacks, for the few rows of aggregated tables: t and normal distributions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def term(n: int) -> float:  # the n-th partial numerator
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def value(depth: int) -> float:  # bottom up
        v = 1.0
        for n in range(depth, 0, -1):
            v = 1 + term(n) / v
        return v

    depth = 32
    last = value(depth)
    while depth < 1 << 14:
        depth *= 2
        new = value(depth)
        if abs(new - last) <= 1e-15 * abs(new):
            return front / new
        last = new
    return front / last


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_cdf(t: float, df: float) -> float:
    p = t_two_sided(t, df) / 2
    return 1 - p if t > 0 else p


def t_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2
    while t_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _each(f: object, *cols: pd.Series) -> pd.Series:
    """f row by row; null where an argument is null or a degree of freedom isn't positive."""
    return pd.Series([f(*x) if all(v is not None and v == v for v in x) and x[-1] > 0 else None for x in zip(*cols, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T >= t)."""
    return _each(lambda x, d: t_cdf(-x, d), t, df)


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    """The quantile of the t distribution."""
    seen: dict = {}
    return _each(lambda q, d: seen.setdefault((q, d), None) or seen.update({(q, d): t_quantile(q, d)}) or seen[q, d], p, df)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal statistic."""
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x is not None and x == x else None for x in z], dtype="float64")
