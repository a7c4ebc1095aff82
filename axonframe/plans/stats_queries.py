"""Queries of the statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.exprs import exclusive_quantiles
from axonframe.operators import stats as S

from .catalogue import query
from .fixtures import LONG, TRIALS, long_trials, trials

ARMS = ["click", "error", "purchase", "signup", "view"]
ALPHA = {"view": 0.0, "click": 0.25, "signup": 0.5, "purchase": 0.75, "error": 1.0}
T_975_DF9 = 2.2621571627409915


def _r(*cols: str, digits: int = 6) -> list[F.Column]:
    return [F.round(c, digits).alias(c) for c in cols]


def _exclusive(p: str) -> str:
    h = f"(len(v) + 1) * {p}::DOUBLE"
    j = f"greatest(1, least(floor({h}), len(v) - 1))::BIGINT"
    return f"coalesce(v[{j}] + ({h} - {j}) * (v[{j} + 1] - v[{j}]), v[1])"


@query(f"""WITH {LONG}, g AS (SELECT metric, arm, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, min(value) AS min, max(value) AS max, list_sort(list(value)) AS v FROM lo GROUP BY 1, 2)
SELECT metric, arm, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(CASE n WHEN 10 THEN mean - {T_975_DF9} * sd / sqrt(n) END, 6) AS ci95_lo, round(CASE n WHEN 10 THEN mean + {T_975_DF9} * sd / sqrt(n) END, 6) AS ci95_hi,
round(min, 6) AS min, round({_exclusive('0.25')}, 6) AS q1, round({_exclusive('0.5')}, 6) AS median, round({_exclusive('0.75')}, 6) AS q3, round(max, 6) AS max, 0::BIGINT AS n_excluded FROM g""")
def describe_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.describe(S.to_long(trials(spark, sf_dir), ["arm", "trial"]))
    return d.select("metric", "arm", "n", *_r("mean", "sd", "sem", "ci95_lo", "ci95_hi", "min", "q1", "median", "q3", "max"), "n_excluded")


@query(f"""WITH {LONG}, v AS (SELECT arm, list_sort(list(value)) AS v FROM (SELECT event_type AS arm, value FROM events) GROUP BY 1)
SELECT arm, round({_exclusive('0.1')}, 6) AS p10, round({_exclusive('0.5')}, 6) AS p50, round({_exclusive('0.9')}, 6) AS p90 FROM v""")
def exclusive_quantiles_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import table

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), "value")
    return exclusive_quantiles(e, ["arm"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).select("arm", *_r("p10", "p50", "p90"))


_MOM = LONG + ", mo AS (SELECT metric, arm, count(*)::DOUBLE AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM lo GROUP BY 1, 2)"
_PAIR = _MOM + """, pa AS (SELECT x.metric, x.arm AS a, y.arm AS b, x.n AS na, y.n AS nb, x.mean AS ma, y.mean AS mb, x.var AS va, y.var AS vb, ma - mb AS diff, sqrt(va / na + vb / nb) AS se,
sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sp FROM mo x JOIN mo y ON x.metric = y.metric AND x.arm < y.arm),
pc AS (SELECT *, diff / nullif(se, 0) AS t, pow(se, 4) / nullif(coalesce(pow(va / na, 2) / nullif(na - 1, 0), 0) + coalesce(pow(vb / nb, 2) / nullif(nb - 1, 0), 0), 0) AS df, diff / nullif(sp, 0) AS d FROM pa)"""
_RANKS = """rk AS (SELECT x.metric, x.a, x.b, l.value, l.arm = x.a AS f, rank() OVER (PARTITION BY x.metric, x.a, x.b ORDER BY l.value) + (count(*) OVER (PARTITION BY x.metric, x.a, x.b, l.value) - 1) / 2.0::DOUBLE AS r,
count(*) OVER (PARTITION BY x.metric, x.a, x.b, l.value) AS ties FROM pc x JOIN lo l ON l.metric = x.metric AND l.arm IN (x.a, x.b)),
mw AS (SELECT metric, a, b, na, nb, u, (u - na * nb / 2 - CASE WHEN u > na * nb / 2 THEN 0.5 WHEN u < na * nb / 2 THEN -0.5 ELSE 0 END) / nullif(sqrt(na * nb / 12 * (na + nb + 1 - tt / ((na + nb) * (na + nb - 1)))), 0) AS z, 1 - 2 * u / (na * nb) AS rank_biserial
FROM (SELECT metric, a, b, count(*) FILTER (f)::DOUBLE AS na, count(*) FILTER (NOT f)::DOUBLE AS nb, sum(r) FILTER (f) - na * (na + 1) / 2 AS u, sum(ties * ties - 1)::DOUBLE AS tt FROM rk GROUP BY 1, 2, 3))"""


def _contrasts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    long = long_trials(spark, sf_dir)
    return long, S.contrasts(S.arm_pairs(S.moments(long)))


@query(f"""WITH {_PAIR}, {_RANKS} SELECT metric, a, b, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(diff, 6) AS diff, round(t, 6) AS t, round(df, 6) AS df, round(d, 6) AS d, round(diff / nullif(sqrt((va + vb) / 2), 0), 6) AS d_plain,
round(d - 1.959963985 * sqrt((na + nb) / (na * nb) + d * d / (2 * (na + nb))), 6) AS d_lo, round(d + 1.959963985 * sqrt((na + nb) / (na * nb) + d * d / (2 * (na + nb))), 6) AS d_hi, round(d * (1 - 3 / (4 * (na + nb) - 9)), 6) AS g,
round(u, 6) AS u, round(z, 6) AS z, round(rank_biserial, 6) AS rank_biserial FROM pc JOIN (SELECT metric, a, b, u, z, rank_biserial FROM mw) USING (metric, a, b)""")
def pair_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, c = _contrasts(spark, sf_dir)
    mw = S.mann_whitney(S.pooled_values(long, c))
    return c.join(mw, ["metric", "a", "b"]).select("metric", "a", "b", "n_a", "n_b", *_r("diff", "t", "df", "d", "d_plain", "d_lo", "d_hi", "g", "u", "z", "rank_biserial"))


def _simpson(f: str, top: str) -> str:
    """The integral of f(x), a SQL expression in x, from 0 to ``top``."""
    return f"(list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('[x]', f'({top} * i / 2000)')})) * {top} / 6000)"


def _half_t(t: str, df: str) -> str:
    """P(0 <= T <= |t|), with T = sqrt(df) * tan(angle)."""
    return f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {_simpson(f'pow(cos([x]), {df} - 1)', f'atan(abs({t}) / sqrt({df}))')}"


@query(f"""WITH {_PAIR}, {_RANKS}, q AS (SELECT metric, a, b, t, df, greatest(0, 1 - 2 * {_half_t('t', 'df')}) AS p FROM pc WHERE t IS NOT NULL AND df IS NOT NULL),
h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY round(p, 12), a, b) + 1) * p) AS raised FROM q)
SELECT metric, a, b, round(t, 6) AS t, round(df, 6) AS df, round(p, 8) AS p, round(max(raised) OVER (PARTITION BY metric ORDER BY round(p, 12), a, b ROWS UNBOUNDED PRECEDING), 8) AS p_holm,
round(greatest(0, 1 - 2 * {_simpson('exp(-[x] * [x] / 2) / sqrt(2 * pi())', 'abs(z)')}), 8) AS p_mw FROM h JOIN (SELECT metric, a, b, z FROM mw) USING (metric, a, b)""")
def pair_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p of Welch's t with Holm's correction within each metric, and the Mann-Whitney p by the normal distribution."""
    from axonframe.functions.special import normal_p_value

    long, c = _contrasts(spark, sf_dir)
    c = S.with_p_values(c).join(S.mann_whitney(S.pooled_values(long, c)), ["metric", "a", "b"]).withColumn("p_mw", normal_p_value("z"))
    c = S.holm(c.filter("p is not null").withColumn("p12", F.round("p", 12)), ["metric"], "p12", ["a", "b"])
    return c.select("metric", "a", "b", *_r("t", "df"), *_r("p", "p_holm", "p_mw", digits=8))


@query()
def pair_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of the differences, by the t quantile."""
    return S.with_p_values(_contrasts(spark, sf_dir)[1]).select("metric", "a", "b", "diff", "diff_lo", "diff_hi")


@query(f"""WITH {_PAIR}, p AS (SELECT metric, a, b, greatest(0, 1 - 2 * {_half_t('t', 'df')}) AS p FROM pc WHERE t IS NOT NULL AND df IS NOT NULL AND 'view' IN (a, b)),
h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY round(p, 12), a, b) + 1) * p) AS raised FROM p)
SELECT metric, a, b, round(p, 8) AS p, round(max(raised) OVER (PARTITION BY metric ORDER BY round(p, 12), a, b ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM h""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's correction of Welch's p over the contrasts with one arm."""
    c = S.with_p_values(_contrasts(spark, sf_dir)[1].filter("a = 'view' or b = 'view'")).filter("p is not null").withColumn("p12", F.round("p", 12))
    return S.holm(c, ["metric"], "p12", ["a", "b"]).select("metric", "a", "b", *_r("p", "p_holm", digits=8))


PERMUTATIONS, TREND_PERMUTATIONS = 4000, 2000
_DRAW = "md5(concat_ws('|', 'perm', j, metric, a, b, arm, trial))"


@query(f"""WITH {LONG}, pp AS (SELECT metric, x.arm AS a, 'view' AS b FROM (SELECT DISTINCT metric, arm FROM lo WHERE arm <> 'view') x),
pv AS (SELECT pp.metric, a, b, arm, trial, value, arm = a AS f FROM pp JOIN lo ON lo.metric = pp.metric AND arm IN (a, b)),
se AS (SELECT metric, a, b, avg(value) FILTER (f) - avg(value) FILTER (NOT f) AS diff, count(*) FILTER (f) AS na FROM pv GROUP BY 1, 2, 3),
pr AS (SELECT *, row_number() OVER (PARTITION BY metric, a, b, j ORDER BY {_DRAW}) AS nth FROM pv, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS j)),
ea AS (SELECT metric, a, b, j, diff, avg(value) FILTER (nth <= na) - avg(value) FILTER (nth > na) AS d FROM pr JOIN se USING (metric, a, b) GROUP BY ALL)
SELECT metric, a, b, round(diff, 6) AS diff, count(*) FILTER (abs(d) >= abs(diff) - 1e-12) AS hits, round((count(*) FILTER (abs(d) >= abs(diff) - 1e-12) + 1) / {PERMUTATIONS + 1}.0::DOUBLE, 9) AS p FROM ea GROUP BY metric, a, b, diff""")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric at 4000 relabellings."""
    v = S.pooled_values(long_trials(spark, sf_dir), S.arm_pairs(S.moments(long_trials(spark, sf_dir)), "view"))
    return S.permutation_test(v, PERMUTATIONS, "perm").select("metric", "a", "b", *_r("diff"), "hits", *_r("p", digits=9))


def _upper_t(t: str, df: str) -> str:
    return f"(0.5 - sign({t}) * {_half_t(t, df)})"


@query(f"""WITH {_MOM}, pa AS (SELECT x.metric, x.arm AS a, y.arm AS b, x.n AS na, y.n AS nb, x.mean - y.mean AS diff, abs(y.mean) AS mb, x.var AS va, y.var AS vb, sqrt(va / na + vb / nb) AS se, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sp FROM mo x JOIN mo y ON x.metric = y.metric AND y.arm = 'view' AND x.arm <> 'view'),
q AS (SELECT *, pow(se, 4) / nullif(pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1), 0) AS df, 0.5 * sp AS bd, 0.1 * mb AS bs FROM pa), u AS (SELECT *, (diff + bd) / nullif(se, 0) AS d1, (bd - diff) / nullif(se, 0) AS d2, (diff + bs) / nullif(se, 0) AS s1, (bs - diff) / nullif(se, 0) AS s2 FROM q)
SELECT metric, a, b, round(diff, 6) AS diff, round(se, 6) AS se, round(df, 6) AS df, round(bd, 6) AS bound_d, round(bs, 6) AS bound_share, se = 0 AS degenerate,
CASE WHEN df IS NOT NULL THEN round(greatest({_upper_t('d1', 'df')}, {_upper_t('d2', 'df')}), 8) END AS p_d, CASE WHEN df IS NOT NULL THEN round(greatest({_upper_t('s1', 'df')}, {_upper_t('s2', 'df')}), 8) END AS p_share FROM u""")
def equivalence_tost(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_trials(spark, sf_dir)
    e = S.equivalence(S.contrasts(S.arm_pairs(S.moments(long), "view")))
    return e.select("metric", "a", "b", *_r("diff", "se", "df", "bound_d", "bound_share"), "degenerate", *_r("p_d", "p_share", digits=8))


@query()
def equivalence_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % intervals of the differences to the reference arm, by the t quantile."""
    long = long_trials(spark, sf_dir)
    return S.equivalence(S.contrasts(S.arm_pairs(S.moments(long), "view"))).select("metric", "a", "b", "ci90_lo", "ci90_hi")


_BF = f"""list_sum(list_transform(range(4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(exp({math.log(1e-8)!r}::DOUBLE + i * {(math.log(1e3) - math.log(1e-8)) / 4000!r}::DOUBLE), -0.5)
* exp({-0.707 * 0.707 / 2!r}::DOUBLE / exp({math.log(1e-8)!r}::DOUBLE + i * {(math.log(1e3) - math.log(1e-8)) / 4000!r}::DOUBLE)) * {0.707 / math.sqrt(2 * math.pi)!r}::DOUBLE
* pow(1 + na * nb / (na + nb) * exp({math.log(1e-8)!r}::DOUBLE + i * {(math.log(1e3) - math.log(1e-8)) / 4000!r}::DOUBLE), -0.5)
* pow(1 + ts * ts / ((1 + na * nb / (na + nb) * exp({math.log(1e-8)!r}::DOUBLE + i * {(math.log(1e3) - math.log(1e-8)) / 4000!r}::DOUBLE)) * (na + nb - 2)), -(na + nb - 1) / 2))) * {(math.log(1e3) - math.log(1e-8)) / 12000!r}::DOUBLE / pow(1 + ts * ts / (na + nb - 2), -(na + nb - 1) / 2)"""


@query(f"""WITH {_PAIR}, q AS (SELECT *, diff / nullif(sp * sqrt(1 / na + 1 / nb), 0) AS ts FROM pc WHERE 'view' IN (a, b))
SELECT metric, a, b, round(ts, 6) AS t, round(log10(bf), 6) AS log10_bf10, round(-log10(bf), 6) AS log10_bf01 FROM (SELECT *, {_BF} AS bf FROM q WHERE ts IS NOT NULL)""")
def bayes_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c = _contrasts(spark, sf_dir)
    t = F.col("diff") / F.nullif(F.col("pooled_sd") * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b")), F.lit(0.0))
    c = c.filter("a = 'view' or b = 'view'").withColumn("t", t).filter("t is not null").withColumn("bf10", S.bayes_factor(F.col("t"), F.col("n_a"), F.col("n_b")))
    return c.select("metric", "a", "b", *_r("t"), F.round(F.log10("bf10"), 6).alias("log10_bf10"), F.round(-F.log10("bf10"), 6).alias("log10_bf01"))


_TREND = LONG + """, pt AS (SELECT metric, arm, trial, value, CASE arm WHEN 'view' THEN 0 WHEN 'click' THEN 0.25 WHEN 'signup' THEN 0.5 WHEN 'purchase' THEN 0.75 ELSE 1 END::DOUBLE AS x FROM lo),
tr2 AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS ry FROM pt)"""


def _dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame(sorted(ALPHA.items()), "arm string, x double")
    return long_trials(spark, sf_dir).join(F.broadcast(levels), "arm")


@query(f"WITH {_TREND} SELECT metric, count(*) AS n, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) AS rho, round(covar_pop(x, value) / nullif(var_pop(x), 0), 6) AS slope FROM tr2 GROUP BY metric HAVING count(*) >= 8")
def spearman_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trend(_dose(spark, sf_dir), ["metric"], "x", "value").select("metric", "n", *_r("rho", "slope"))


@query(f"""WITH {_TREND}, js AS (SELECT *, row_number() OVER (PARTITION BY metric, j ORDER BY arm, trial) AS at, row_number() OVER (PARTITION BY metric, j ORDER BY md5(concat_ws('|', 'trend', j, metric, arm, trial))) AS to_ FROM tr2, (SELECT unnest(range({TREND_PERMUTATIONS + 1})) AS j)),
rh AS (SELECT l.metric, l.j, covar_samp(l.rx, r.ry) / nullif(stddev_samp(l.rx) * stddev_samp(r.ry), 0) AS rho FROM js l JOIN js r ON l.metric = r.metric AND l.j = r.j AND l.at = CASE WHEN r.j = 0 THEN r.at ELSE r.to_ END GROUP BY 1, 2)
SELECT p.metric, round(s.rho, 6) AS rho, round((count(*) FILTER (abs(p.rho) >= abs(s.rho) - 1e-12) + 1) / {TREND_PERMUTATIONS + 1}.0::DOUBLE, 9) AS p FROM rh p JOIN rh s ON p.metric = s.metric AND s.j = 0 WHERE p.j > 0 GROUP BY 1, s.rho""")
def trend_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric at 2000 permutations."""
    return S.trend_permutation_p(_dose(spark, sf_dir), ["metric"], "x", "value", ["arm", "trial"], TREND_PERMUTATIONS, "trend").select("metric", *_r("rho"), *_r("p", digits=9))


@query(f"WITH {_MOM} SELECT metric, {', '.join(f'''round(max(mean) FILTER (arm = '{a}'), 6) AS \"{a}\"''' for a in ARMS)} FROM mo GROUP BY metric")
def wide_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digest(S.moments(long_trials(spark, sf_dir)), ARMS).select("metric", *_r(*ARMS))


EXPECTED = [("n", "view", 200.0, 60.0), ("mean_value", "click", 50.0, 60.0), ("users", "error", 1e9, 1.0), ("absent", "view", 1.0, 1.0)]


@query(f"""WITH {_MOM}, ex(metric, arm, expected, tolerance) AS (VALUES {', '.join(f"('{m}', '{a}', {e}::DOUBLE, {t}::DOUBLE)" for m, a, e, t in EXPECTED)})
SELECT metric, arm, round(mean, 6) AS got, expected, coalesce(abs(mean - expected) <= tolerance, false) AS holds FROM ex LEFT JOIN mo USING (metric, arm)""")
def headline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(EXPECTED, "metric string, arm string, expected double, tolerance double")
    return S.headline(S.moments(long_trials(spark, sf_dir)), e).select("metric", "arm", *_r("got"), "expected", "holds")


@query(f"""WITH {_PAIR} SELECT metric, CASE WHEN a = 'purchase' THEN b ELSE a END AS other, round(CASE WHEN a = 'purchase' THEN diff ELSE -diff END, 6) AS diff, round(CASE WHEN a = 'purchase' THEN d ELSE -d END, 6) AS d FROM pc WHERE 'purchase' IN (a, b)""")
def oriented_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.oriented(_contrasts(spark, sf_dir)[1], "purchase").select("metric", "other", *_r("diff", "d"))


@query(f"WITH {_MOM} SELECT metric, arm, round(mean - 2.262 * sqrt(var) / sqrt(n), 6) AS lo_small, round(mean + 1.96 * sqrt(var) / sqrt(n), 6) AS hi_normal FROM mo")
def dose_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.moments(long_trials(spark, sf_dir))
    sd = F.sqrt("var")
    lo, _ = S.interval(F.col("mean"), sd, F.col("n"), "small")
    _, hi = S.interval(F.col("mean"), sd, F.col("n"), "normal")
    return m.select("metric", "arm", F.round(lo, 6).alias("lo_small"), F.round(hi, 6).alias("hi_normal"))


@query(f"WITH {TRIALS} SELECT arm, count(*) AS trials, round(avg(n), 6) AS rate FROM tr GROUP BY arm")
def trial_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).groupBy("arm").agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("n"), 6).alias("rate"))
