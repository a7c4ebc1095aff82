"""Comparative statistics over long tables ``arm, trial, metric, value``.

Group-level work is a plain aggregation; contrasts join the small table of moments with itself on the metric. Only
t and normal distribution functions run in Python, on one row a contrast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions import special
from axonframe.functions.exprs import average_rank, exclusive_quantiles, is_finite, ratio, safe_corr, safe_slope
from axonframe.functions.rng import hash_key


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, value, finite``: a row for each other column that was computed (null ones are left out, NaN is kept)."""
    metrics = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
    long = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.metric", "p.value").filter("value is not null")
    return long.withColumn("finite", is_finite("value"))


def moments(long: DataFrame, by: tuple[str, ...] = ("metric", "arm")) -> DataFrame:
    """n, mean and variance (0 for one row) of each group."""
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))


def describe(long: DataFrame) -> DataFrame:
    """n, mean, sd, sem, 95 % interval, extremes, exclusive quartiles and the count of non-finite values, by metric and arm."""
    by = ["metric", "arm"]
    good = long.filter("finite")
    base = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    base = base.join(exclusive_quantiles(good, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), by)
    lost = long.groupBy(*by).agg(F.count_if(~F.col("finite")).alias("n_excluded"))
    out = lost.join(base, by, "left").withColumn("sem", F.col("sd") / F.sqrt("n"))
    half = special.t_critical(F.lit(0.975), (F.col("n") - 1).cast("double")) * F.col("sem")
    return out.withColumn("half", half).select(*by, "n", "mean", "sd", "sem", (F.col("mean") - F.col("half")).alias("ci95_lo"), (F.col("mean") + F.col("half")).alias("ci95_hi"), "min", "q1", "median", "q3", "max", "n_excluded")


def interval(mean: Column, sd: Column, n: Column, rule: str = "t") -> tuple[Column, Column]:
    """A 95 % interval of a mean: ``t`` by the t quantile, ``small`` 2.262 up to n = 10 and 1.96 beyond, ``normal`` 1.96 always."""
    z = special.t_critical(F.lit(0.975), (n - 1).cast("double")) if rule == "t" else F.when(n <= 10, 2.262).otherwise(1.96) if rule == "small" else F.lit(1.96)
    half = z * sd / F.sqrt(n)
    return mean - half, mean + half


def arm_pairs(stats: DataFrame, reference: str | None = None) -> DataFrame:
    """All pairs of arms of a metric with both arms' moments: ``a < b`` by name, or each arm (a) against a reference (b)."""
    side = lambda s: stats.select("metric", *[F.col(c).alias(f"{c}_{s}" if c != "arm" else s) for c in ("arm", "n", "mean", "var")])
    rule = F.col("a") < F.col("b") if reference is None else (F.col("b") == reference) & (F.col("a") != reference)
    return side("a").join(side("b"), "metric").filter(rule)


def contrasts(pairs: DataFrame) -> DataFrame:
    """Welch's t and df, Cohen's d (pooled, and by the mean of the variances), its interval, and Hedges' g.

    With no variance in either arm t, df and d are null: nothing was estimated.
    """
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("var_a"), F.col("var_b")
    out = pairs.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("se", F.sqrt(va / na + vb / nb))
    part = lambda v, n: F.pow(v / n, F.lit(2)) / F.nullif(n - 1, F.lit(0))
    spread = F.coalesce(part(va, na), F.lit(0.0)) + F.coalesce(part(vb, nb), F.lit(0.0))
    pooled = F.sqrt(ratio((na - 1) * va + (nb - 1) * vb, na + nb - 2))
    out = out.withColumns({"t": ratio("diff", "se"), "df": ratio(F.pow("se", F.lit(4)), spread), "d": ratio(F.col("diff"), pooled), "d_plain": ratio(F.col("diff"), F.sqrt((va + vb) / 2)), "pooled_sd": pooled})
    se_d = F.sqrt((na + nb) / (na * nb) + F.pow("d", F.lit(2)) / (2 * (na + nb)))
    return out.withColumns({"d_lo": F.col("d") - 1.959963985 * se_d, "d_hi": F.col("d") + 1.959963985 * se_d, "g": F.col("d") * (1 - 3 / (4.0 * (na + nb) - 9))})


def with_p_values(c: DataFrame) -> DataFrame:
    """``p`` and the difference's 95 % interval for :func:`contrasts`."""
    half = special.t_critical(F.lit(0.975), F.col("df")) * F.col("se")
    return c.withColumn("p", special.t_p_value("t", "df")).withColumn("half", half).withColumn("diff_lo", F.col("diff") - F.col("half")).withColumn("diff_hi", F.col("diff") + F.col("half")).drop("half")


def pooled_values(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """``metric, a, b, first, trial, value``: each pair's values; ``first`` tells those of arm a. Joined by arm, no cross join."""
    keys = pairs.select("metric", "a", "b", F.explode(F.array(F.struct(F.col("a").alias("arm"), F.lit(True).alias("first")), F.struct(F.col("b").alias("arm"), F.lit(False).alias("first")))).alias("s"))
    return keys.select("metric", "a", "b", "s.arm", "s.first").join(long, ["metric", "arm"])


def mann_whitney(values: DataFrame, copysign_at_zero: bool = False) -> DataFrame:
    """U of arm a, z with ties and continuity corrected, and the rank-biserial correlation, from :func:`pooled_values`.

    At U = mean no correction applies; ``copysign_at_zero`` subtracts half there too.
    """
    by = ["metric", "a", "b"]
    ranked = values.withColumn("r", average_rank(by, "value")).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(*by, "value")))
    s = ranked.groupBy(*by).agg(F.sum(F.when(F.col("first"), F.col("r"))).alias("r1"), F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"), F.sum(F.pow("ties", F.lit(2)) - 1).alias("tie_term"))
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    u = F.col("r1") - na * (na + 1) / 2.0
    off = u - na * nb / 2.0
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    shift = F.when(off > 0, 0.5).when(off < 0, -0.5).otherwise(0.5 if copysign_at_zero else 0.0)
    return s.select(*by, u.alias("u"), ratio(off - shift, sd).alias("z"), (1 - 2 * u / (na * nb)).alias("rank_biserial"))


def holm(df: DataFrame, family: list[str], p: str, order: list[str]) -> DataFrame:
    """``df`` with ``p_holm`` within each family; ties by ``order``."""
    w = W.partitionBy(*family).orderBy(p, *order)
    raised = F.least(F.lit(1.0), (F.count(F.lit(1)).over(W.partitionBy(*family)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_raised", raised).withColumn("p_holm", F.max("_raised").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_raised")


def permutation_test(values: DataFrame, permutations: int, seed: str) -> DataFrame:
    """``diff, hits, p`` of the mean difference by hash-ordered permutations of each pair's pool; p = (hits + 1) / (permutations + 1).

    Permutation j orders a pool by md5(seed|j|...) and takes the first n_a rows as arm a. A permutation's rows are a
    window partition of their own, so the permutations spread over the cluster.
    """
    by = ["metric", "a", "b"]
    seen = values.groupBy(*by).agg((F.avg(F.when(F.col("first"), F.col("value"))) - F.avg(F.when(~F.col("first"), F.col("value")))).alias("diff"), F.count_if("first").alias("na"), F.count_if(~F.col("first")).alias("nb"))
    rows = values.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    nth = F.row_number().over(W.partitionBy(*by, "j").orderBy(hash_key(seed, "j", "metric", "a", "b", "arm", "trial")))
    drawn = rows.withColumn("nth", nth).join(seen, by).withColumn("in_a", F.col("nth") <= F.col("na"))
    each = drawn.groupBy(*by, "j", "diff").agg((F.avg(F.when(F.col("in_a"), F.col("value"))) - F.avg(F.when(~F.col("in_a"), F.col("value")))).alias("d"))
    return each.groupBy(*by, "diff").agg(F.count_if(F.abs("d") >= F.abs("diff") - 1e-12).alias("hits")).withColumn("p", (F.col("hits") + 1) / F.lit(permutations + 1.0))


def equivalence(c: DataFrame, sd_bound: float = 0.5, share_bound: float = 0.1) -> DataFrame:
    """Two one-sided tests of :func:`contrasts` at a standardised bound and at a share of |mean of b|.

    Without any variance p is null and ``degenerate`` true, rather than a proof of equivalence.
    """
    out = c.withColumn("degenerate", F.col("se") == 0).withColumn("bound_d", F.col("pooled_sd") * sd_bound).withColumn("bound_share", F.abs("mean_b") * share_bound)
    for name in ("d", "share"):
        b = F.col(f"bound_{name}")
        out = out.withColumn(f"p_{name}", F.greatest(special.t_upper(ratio(F.col("diff") + b, "se"), F.col("df")), special.t_upper(ratio(b - F.col("diff"), "se"), F.col("df"))))
    half = special.t_critical(F.lit(0.95), F.col("df")) * F.col("se")
    return out.withColumn("half", half).withColumn("ci90_lo", F.col("diff") - F.col("half")).withColumn("ci90_hi", F.col("diff") + F.col("half")).drop("half")


LOG_G = (math.log(1e-8), math.log(1e3))


def bayes_factor(t: Column, na: Column, nb: Column, scale: float = 0.707, points: int = 4001) -> Column:
    """BF10 of a two-sample t by Simpson's rule over log g, g the variance of a Cauchy prior of that scale; built-in functions only."""
    lo, hi = LOG_G
    h = (hi - lo) / (points - 1)
    nu, eff = (na + nb - 2).cast("double"), na * nb / (na + nb).cast("double")

    def term(i: Column) -> Column:
        g = F.exp(lo + i * F.lit(h))
        weight = F.when((i == 0) | (i == points - 1), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        prior = F.pow(g, F.lit(-0.5)) * F.exp(F.lit(-scale * scale / 2) / g) * (scale / math.sqrt(2 * math.pi))  # times g, as the grid is in log g
        return weight * prior * F.pow(1 + eff * g, F.lit(-0.5)) * F.pow(1 + t * t / ((1 + eff * g) * nu), -(nu + 1) / 2)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0.0), lambda s, i: s + term(i))
    return total * (h / 3) / F.pow(1 + t * t / nu, -(nu + 1) / 2)


def trend(points: DataFrame, by: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """``n, rho, slope``: Spearman's correlation and the least-squares slope of y on x by group; null if either is constant or rows are few."""
    ranked = points.withColumn("rx", average_rank(by, x)).withColumn("ry", average_rank(by, y))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("rx", "ry").alias("rho"), safe_slope(x, y).alias("slope")).filter(F.col("n") >= least)


def trend_permutation_p(points: DataFrame, by: list[str], x: str, y: str, ids: list[str], permutations: int, seed: str) -> DataFrame:
    """p of Spearman's rho by hash-ordered permutations of y's ranks."""
    ranked = points.withColumn("rx", average_rank(by, x)).withColumn("ry", average_rank(by, y)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    w = W.partitionBy(*by, "j")
    ranked = ranked.withColumn("at", F.row_number().over(w.orderBy(*ids))).withColumn("to", F.row_number().over(w.orderBy(hash_key(seed, "j", *by, *ids))))
    left = ranked.select(*by, "j", "at", "rx")
    right = ranked.select(*by, "j", F.when(F.col("j") == 0, F.col("at")).otherwise(F.col("to")).alias("at"), "ry")  # j = 0: as observed
    rho = left.join(right, [*by, "j", "at"]).groupBy(*by, "j").agg(safe_corr("rx", "ry").alias("rho"))
    seen = rho.filter("j = 0").select(*by, F.col("rho").alias("seen"))
    return rho.filter("j > 0").join(seen, by).groupBy(*by, F.col("seen").alias("rho")).agg(((F.count_if(F.abs("rho") >= F.abs("seen") - 1e-12) + 1) / F.lit(permutations + 1.0)).alias("p"))


def oriented(c: DataFrame, reference: str) -> DataFrame:
    """Contrasts with signs as reference minus the other arm, however the pair was listed."""
    turn = F.when(F.col("a") == reference, F.lit(1.0)).otherwise(F.lit(-1.0))
    keep = c.filter((F.col("a") == reference) | (F.col("b") == reference))
    return keep.withColumn("other", F.when(F.col("a") == reference, F.col("b")).otherwise(F.col("a"))).withColumn("turn", turn).withColumns({x: F.col(x) * F.col("turn") for x in ("diff", "d") if x in c.columns}).drop("turn")


def digest(stats: DataFrame, arms: list[str]) -> DataFrame:
    """``metric`` and a column of means for each arm."""
    return stats.groupBy("metric").pivot("arm", arms).agg(F.first("mean"))


def headline(stats: DataFrame, expected: DataFrame) -> DataFrame:
    """``metric, arm, got, expected, tolerance, holds`` for a table of numbers that must come out."""
    out = expected.join(stats.select("metric", "arm", F.col("mean").alias("got")), ["metric", "arm"], "left")
    return out.withColumn("holds", F.coalesce(F.abs(F.col("got") - F.col("expected")) <= F.col("tolerance"), F.lit(False)))
