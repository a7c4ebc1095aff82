"""Expressions that need care: guarded divisions, correlations and slopes, exclusive quantiles, angles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return _c(a) / F.nullif(_c(b).cast("double"), F.lit(0.0))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation; null for a constant column or fewer than two rows, where ``corr`` would throw."""
    return ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def safe_slope(x: Column | str, y: Column | str) -> Column:
    """Least-squares slope of y on x; null for constant x."""
    return ratio(F.covar_pop(x, y), F.var_pop(x))


def exact_mean(x: Column | str) -> Column:
    """An aggregate: the mean of decimal values, such as amounts, that no order of rows changes: the double next to their true sum, divided by their number.

    Sums of doubles end in other last digits by the order of rows, so that a mean lies now on a threshold, now below it. Here values
    are added as decimals of 8 places. A group with a value that isn't one (or 1e12 or more, or not finite) has the mean of doubles.
    """
    x = _c(x).cast("double")
    d = x.try_cast("decimal(20,8)")
    mean = F.try_divide(F.try_sum(d).cast("double"), F.count(d))
    return F.when(F.bool_and(F.when(x.isNotNull(), F.coalesce(d.cast("double") == x, F.lit(False)))) & mean.isNotNull(), mean).otherwise(F.avg(x))


def wrap_angle(a: Column | str) -> Column:
    """The angle in (-pi, pi]."""
    a = _c(a)
    w = a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi))
    return F.when(w == -math.pi, F.lit(math.pi)).otherwise(w)


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def squash(x: Column | str) -> Column:
    """x / (1 + x) for what is not negative."""
    x = F.greatest(_c(x), F.lit(0.0))
    return x / (1 + x)


def is_finite(x: Column | str) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def exclusive_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles with position p * (n + 1), clamped to neighbours that exist, by group; one row has itself at each.

    Positions come from a sort that spills, not from a collected list.
    """
    w = W.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    out = []
    for name, p in at.items():
        h = F.col("_n") * p + p
        j = F.greatest(F.lit(1), F.least(F.floor(h), F.col("_n") - 1))
        lo, hi = F.max(F.when(F.col("_r") == j, F.col(value))), F.max(F.when(F.col("_r") == j + 1, F.col(value)))
        frac = F.max(h - j)
        out.append(F.coalesce(lo + frac * (hi - lo), lo).alias(name))
    return ranked.groupBy(*by).agg(*out)


def average_rank(partition: list[str], value: str) -> Column:
    """Rank within the partition, ties by the mean of their places."""
    return F.rank().over(W.partitionBy(*partition).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*partition, value)) - 1) / 2.0


def _bucket_of(key: str, edges: list[float]) -> Column:
    """How many of the sorted edges lie under the key, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(`{key}` <= {edges[mid]!r}{'D' if isinstance(edges[mid], float) else ''}, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return F.expr(tree(0, len(edges)))


def prefix_sums(df: DataFrame, key: str, sums: dict[str, Column], buckets: int = 128) -> DataFrame:
    """``df`` with inclusive running sums in the order of a numeric key without a single-task window over all rows.

    Rows are cut at ``buckets`` approximate quantiles of the key, so that a bucket has about as many rows as any, however the keys lie. Running
    sums inside a bucket are a window by bucket; what lies before it is a running sum over the buckets' totals (at most
    ``buckets`` rows). Rows with equal keys share a value (the range frame's rule).
    """
    cuts = df.agg(F.percentile_approx(key, [k / buckets for k in range(1, buckets)], 10_000)).first()[0]
    if cuts is None:
        return df.select("*", *[F.lit(None).cast("double").alias(n) for n in sums])
    at = _bucket_of(key, sorted({c for c in cuts if abs(c) < math.inf}))
    rows = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()]).withColumn("_bucket", at)
    totals = rows.groupBy("_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    inside = W.partitionBy("_bucket").orderBy(key).rangeBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(totals), "_bucket")
    return out.select(*df.columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_t_{n}")).alias(n) for n in sums])
