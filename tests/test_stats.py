import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.functions import special
from axonframe.operators import stats as S
from axonframe.plans.all import QUERIES
from axonframe.plans.fixtures import long_trials

#: Bayes factors of two samples of ten at six t, and the largest evidence for no effect by sample size.
BF10 = {0.0: 0.3973, 0.5: 0.4341, 1.0: 0.5634, 2.0: 1.4964, 3.0: 6.2818, 4.0: 34.4220}
BF01_MOST = {10: 2.52, 16: 2.97, 20: 3.24, 30: 3.81, 50: 4.74}


def test_bayes_factor_anchors(spark):
    df = spark.createDataFrame([(t, 10) for t in BF10] + [(0.0, n) for n in BF01_MOST], "t double, n int")
    for r in df.withColumn("bf", S.bayes_factor(F.col("t"), F.col("n"), F.col("n"))).collect():
        if r.n == 10:
            assert r.bf == pytest.approx(BF10[r.t], abs=6e-5)
        if r.t == 0:
            assert 1 / r.bf == pytest.approx(BF01_MOST[r.n], abs=6e-3)


@pytest.mark.parametrize(("t", "df", "p"), [(0, 5, 1.0), (2.2621571627409915, 9, 0.05), (1.959963984540054, 1e7, 0.05), (12.706204736432095, 1, 0.05), (1.0, 1, 0.5)])
def test_t_distribution(t, df, p):
    assert special.t_two_sided(t, df) == pytest.approx(p, rel=1e-6)
    if t:
        assert special.t_quantile(1 - p / 2, df) == pytest.approx(t, rel=1e-6)


def test_beta_symmetry():
    for a, b, x in ((2, 3, 0.4), (0.5, 7, 0.01), (50, 50, 0.5), (1, 1, 0.3)):
        assert special.beta_inc(a, b, x) + special.beta_inc(b, a, 1 - x) == pytest.approx(1)
    assert special.beta_inc(1, 1, 0.3) == pytest.approx(0.3)


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(5)
    rows = [(arm, k, "m", round(rng.gauss(mu, 1), 1)) for arm, mu in (("a", 0), ("b", 0.5), ("c", 2)) for k in range(9)]
    rows += [(arm, k, "flat", 1.0) for arm in "ab" for k in range(4)] + [("a", 9, "m", float("nan")), ("a", 10, "m", float("inf")), ("solo", 0, "m", 3.0)]
    return spark.createDataFrame(rows, "arm string, trial int, metric string, value double").withColumn("finite", ~F.isnan("value") & (F.abs("value") < float("inf")))


def test_describe(long):
    got = {(r.metric, r.arm): r for r in S.describe(long).collect()}
    for (metric, arm), r in got.items():
        v = [x.value for x in long.filter("finite").collect() if (x.metric, x.arm) == (metric, arm)]
        assert (r.n, r.n_excluded) == (len(v), 2 if (metric, arm) == ("m", "a") else 0)
        assert r.mean == pytest.approx(statistics.fmean(v))
        if len(v) > 1:
            assert [r.q1, r.median, r.q3] == pytest.approx(statistics.quantiles(v, n=4))
            assert r.sd == pytest.approx(statistics.stdev(v))
        else:
            assert (r.q1, r.median, r.q3, r.sd, r.ci95_lo) == (3.0, 3.0, 3.0, 0.0, None)


def test_contrasts_without_variance_are_null(long):
    good = long.filter("finite")
    c = S.equivalence(S.contrasts(S.arm_pairs(S.moments(good)))).collect()
    flat = next(r for r in c if r.metric == "flat")
    assert flat.degenerate and flat.t is None and flat.d is None and flat.p_d is None
    m = next(r for r in c if (r.metric, r.a, r.b) == ("m", "a", "b"))
    assert not m.degenerate and 0 <= m.p_d <= 1


def test_mann_whitney_by_counting(long):
    good = long.filter("finite").filter("metric = 'm'")
    v = {}
    for r in good.collect():
        v.setdefault(r.arm, []).append(r.value)
    for r in S.mann_whitney(S.pooled_values(good, S.arm_pairs(S.moments(good)))).collect():
        u = sum((x > y) + 0.5 * (x == y) for x in v[r.a] for y in v[r.b])
        assert r.u == pytest.approx(u)
        assert r.rank_biserial == pytest.approx(1 - 2 * u / (len(v[r.a]) * len(v[r.b])))


def test_holm_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2]
    df = spark.createDataFrame([("x", k, v) for k, v in enumerate(p)], "f string, k int, p double")
    got = sorted((r.p, r.p_holm) for r in S.holm(df, ["f"], "p", ["k"]).collect())
    assert [h for _, h in got] == pytest.approx([0.025, 0.04, 0.09, 0.09, 0.2])


def test_permutation_p(long):
    good = long.filter("finite").filter("metric = 'm' and arm in ('a', 'b', 'c')")
    rows = {r.a: r for r in S.permutation_test(S.pooled_values(good, S.arm_pairs(S.moments(good), "a")), 99, "s").collect()}
    assert all(r.p >= 0.01 and math.isclose(r.p, (r.hits + 1) / 100) for r in rows.values())
    assert rows["c"].p < rows["b"].p


def test_trend_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("m", float(k), 1.0) for k in range(9)], "g string, x double, y double")
    r = S.trend(df, ["g"], "x", "y").first()
    assert r.rho is None and r.slope == 0


def test_interval_rules(spark):
    df = spark.createDataFrame([(0.0, 1.0, 4), (0.0, 1.0, 16)], "m double, s double, n int")
    lo, _ = S.interval(F.col("m"), F.col("s"), F.col("n"), "small")
    assert [r[0] for r in df.select(lo).collect()] == pytest.approx([-1.131, -0.49])


def test_permutations_cover_every_metric(spark):
    from axonframe.plans.all import QUERIES
    from axonframe.plans.fixtures import METRICS

    p = QUERIES["permutation_p"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.metric, r.a) for r in p} == {(m, a) for m in METRICS for a in ("click", "error", "purchase", "signup")}
    assert all(r.p == round((r.hits + 1) / 4001, 9) for r in p)
    t = QUERIES["trend_permutation"](spark, "/root/testdata/sf0.001").collect()
    assert {r.metric for r in t} == set(METRICS)
    assert all(abs(r.p * 2001 - round(r.p * 2001)) < 1e-4 for r in t)


def half_t(t, df):
    """P(0 <= T <= t) by Simpson's rule."""
    x = np.linspace(0, np.arctan(t / np.sqrt(df)), 4001)
    y = np.cos(x) ** (df - 1)
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * area


def test_intervals_hold_their_share_of_the_distribution(spark):
    sf = "/root/testdata/sf0.001"
    c = {(r.metric, r.a, r.b): r for r in S.contrasts(S.arm_pairs(S.moments(long_trials(spark, sf)))).collect()}
    rows = QUERIES["pair_intervals"](spark, sf).collect()
    assert len(rows) == len(c)
    for r in rows:
        x = c[r.metric, r.a, r.b]
        if x.df is not None:
            assert r.diff_hi + r.diff_lo == pytest.approx(2 * x["diff"])
            assert half_t((r.diff_hi - x["diff"]) / x.se, x.df) == pytest.approx(0.475, abs=1e-7)
    e = {(r.metric, r.a): r for r in S.contrasts(S.arm_pairs(S.moments(long_trials(spark, sf)), "view")).collect()}
    for r in QUERIES["equivalence_intervals"](spark, sf).collect():
        x = e[r.metric, r.a]
        if x.df is not None:
            assert r.ci90_hi + r.ci90_lo == pytest.approx(2 * x["diff"])
            assert half_t((r.ci90_hi - x["diff"]) / x.se, x.df) == pytest.approx(0.45, abs=1e-7)
