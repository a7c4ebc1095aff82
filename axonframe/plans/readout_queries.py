"""Queries of readouts, stimuli and simulations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.exprs import prefix_sums
from axonframe.operators import experiments as X
from axonframe.operators import readout as R
from axonframe.operators import stimulus as S
from axonframe.operators.simulate import CircuitTable, packed, run_trials, spikes_only
from axonframe.sources.tables import stored

from .catalogue import query
from .fixtures import SPIKES, event_graph, spikes, table

DAY = 86400.0
DAYS = 30
SPAN = DAY * DAYS
ARMS = ["click", "error", "purchase", "signup", "view"]


def _r(*cols: str, digits: int = 6) -> list[F.Column]:
    return [F.round(c, digits).alias(c) for c in cols]


_RATES = SPIKES + f""", pr AS (SELECT arm, neuron, trial, count(*) / {SPAN}::DOUBLE * 1000 AS r FROM sk GROUP BY 1, 2, 3),
fr AS (SELECT arm, neuron, sum(r) / 10 AS rate, sqrt(greatest(0, sum(r * r) / 10 - pow(sum(r) / 10, 2))) AS sd FROM pr GROUP BY 1, 2)"""


@query(f"""WITH {_RATES} SELECT neuron, coalesce(max(c_name), '') AS name, {', '.join(f'''round(coalesce(max(rate) FILTER (arm = '{a}'), 0), 6) AS "{a}"''' for a in ARMS)}
FROM fr LEFT JOIN customer ON c_custkey = neuron AND c_custkey % 2 = 0 GROUP BY neuron""")
def spike_rate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = R.firing_rates(spikes(spark, sf_dir), SPAN / 1000, 10)
    names = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("neuron"), F.col("c_name").alias("name"))
    return R.rate_table(rates, names, ARMS).select("neuron", "name", *_r(*ARMS))


@query(f"WITH {_RATES} SELECT arm, neuron, round(rate, 6) AS rate, round(sd, 6) AS sd FROM fr")
def firing_rate_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.firing_rates(spikes(spark, sf_dir), SPAN / 1000, 10).select("arm", "neuron", *_r("rate", "sd"))


_BINS = SPIKES + f", bi AS (SELECT arm, neuron, floor(t / {DAY})::BIGINT AS bin, count(*) AS n FROM sk WHERE t >= 0 AND t < {SPAN} GROUP BY 1, 2, 3)"


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.binned(spikes(spark, sf_dir), ["arm", "neuron"], DAY, 0.0, SPAN)


@query(f"""WITH {_BINS}, mo AS (SELECT arm, neuron, sum(n) / {DAYS}.0::DOUBLE AS mean, sqrt(greatest(0, (sum(n * n) - {DAYS} * pow(sum(n) / {DAYS}.0::DOUBLE, 2)) / {DAYS - 1})) AS sd FROM bi GROUP BY 1, 2)
SELECT arm, neuron, bin, n, round((n - mean) / (sd + 1e-6), 6) AS z FROM bi JOIN mo USING (arm, neuron)""")
def binned_state_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.z_scores(_bins(spark, sf_dir), ["arm", "neuron"], DAYS).select("arm", "neuron", "bin", "n", *_r("z"))


@query(f"""WITH {SPIKES}, ce AS (SELECT DISTINCT neuron, neuron % 3 AS family FROM sk), c AS (SELECT arm, neuron, count(*) / 30.0::DOUBLE AS rate FROM sk GROUP BY 1, 2),
ev AS (SELECT a.arm, ce.neuron, family, coalesce(rate, 0) AS rate FROM (SELECT DISTINCT arm FROM sk) a JOIN ce ON true LEFT JOIN c ON c.arm = a.arm AND c.neuron = ce.neuron)
SELECT ev.arm, coalesce(family, -1)::BIGINT AS family, count(*) AS cells, round(avg(rate), 6) AS mean_rate, round(count(*) FILTER (rate > 0.5) / count(*), 6) AS active FROM (SELECT arm, neuron, family, rate FROM ev) ev GROUP BY GROUPING SETS ((arm, family), (arm))""")
def family_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spikes(spark, sf_dir)
    cells = s.select("neuron").distinct().withColumn("family", F.col("neuron") % 3)
    return R.activity(s, cells, 30.0, 0.5).select("arm", F.coalesce("family", F.lit(-1)).cast("long").alias("family"), "cells", *_r("mean_rate", "active"))


@query(f"""WITH {_BINS}, pb AS (SELECT arm, bin, sum(n) / 100.0::DOUBLE AS r FROM bi GROUP BY 1, 2)
SELECT arm, round(sum(r) / {DAYS}, 6) AS mean_rate, round(sqrt(greatest(0, sum(r * r) / {DAYS} - pow(sum(r) / {DAYS}, 2))), 6) AS sd_rate FROM pb GROUP BY arm""")
def population_rate_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.population_deviation(_bins(spark, sf_dir), ["arm"], 100, DAYS, 1.0).select("arm", *_r("mean_rate", "sd_rate"))


PAIRS = 300


def _draw(side: str) -> str:
    return f"floor(('0x' || substr(md5('pairs|' || j || '|{side}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT n FROM nn))::BIGINT"


@query(f"""WITH {_BINS}, k AS (SELECT neuron, row_number() OVER (ORDER BY neuron) - 1 AS k FROM (SELECT DISTINCT neuron FROM sk)), nn AS (SELECT count(*) AS n FROM k),
dr AS (SELECT least(x, y) AS x, greatest(x, y) AS y, min(j) AS j FROM (SELECT j, {_draw('a')} AS x, {_draw('b')} AS y FROM (SELECT unnest(range(1, {R.PAIR_DRAWS + 1})) AS j)) WHERE x <> y GROUP BY 1, 2 ORDER BY j LIMIT {PAIRS}),
ch AS (SELECT 0 AS j, x.neuron AS a, y.neuron AS b FROM k x JOIN k y ON x.k < y.k WHERE (SELECT n * (n - 1) // 2 FROM nn) <= {PAIRS} UNION ALL SELECT j, u.neuron, v.neuron FROM dr JOIN k u ON u.k = x JOIN k v ON v.k = y WHERE (SELECT n * (n - 1) // 2 FROM nn) > {PAIRS}),
pa AS (SELECT row_number() OVER (ORDER BY j, a, b) - 1 AS pair, a, b FROM ch), sp AS (SELECT arm, pair, a, b, bin FROM (SELECT DISTINCT arm FROM sk), pa, (SELECT unnest(range({DAYS})) AS bin)),
xy AS (SELECT sp.arm, pair, coalesce(x.n, 0)::DOUBLE AS x, coalesce(y.n, 0)::DOUBLE AS y FROM sp LEFT JOIN bi x ON x.arm = sp.arm AND x.neuron = a AND x.bin = sp.bin LEFT JOIN bi y ON y.arm = sp.arm AND y.neuron = b AND y.bin = sp.bin)
SELECT arm, pair, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS r FROM xy GROUP BY arm, pair HAVING sum(x) + sum(y) > 0""")
def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 300 distinct pairs, or all where there are fewer."""
    pairs = R.distinct_pairs(spikes(spark, sf_dir).select("neuron").distinct(), PAIRS, "pairs")
    return R.pair_correlations(_bins(spark, sf_dir), pairs, DAYS).select("arm", "pair", *_r("r"))


_SERIES = _BINS + f", se AS (SELECT arm, bin, coalesce(s, 0)::DOUBLE AS x FROM (SELECT arm, bin FROM (SELECT DISTINCT arm FROM bi), (SELECT unnest(range({DAYS})) AS bin)) LEFT JOIN (SELECT arm, bin, sum(n) AS s FROM bi GROUP BY 1, 2) USING (arm, bin))"


LAGS = min(30, DAYS // 2)  #: lags below it count


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_series(_bins(spark, sf_dir), ["arm"], DAYS)


@query(f"""WITH {_SERIES}, d AS (SELECT arm, bin, x - avg(x) OVER (PARTITION BY arm) AS x FROM se), v AS (SELECT arm, sum(x * x) AS v FROM d GROUP BY 1),
ac AS (SELECT a.arm, b.bin - a.bin AS lag, sum(a.x * b.x) / any_value(v) AS acf FROM d a JOIN d b ON a.arm = b.arm AND b.bin - a.bin BETWEEN 0 AND {LAGS - 1} JOIN v ON v.arm = a.arm GROUP BY 1, 2)
SELECT arm, round(sum(greatest(0, acf)) * 0.5, 6) AS tau FROM ac GROUP BY arm""")
def autocorr_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.autocorrelation_time(_series(spark, sf_dir), ["arm"], 0.5, LAGS - 1).select("arm", *_r("tau"))


@query("""WITH e AS (SELECT row_number() OVER () AS k, label, embedding FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT k, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e),
c AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM u a JOIN u b ON a.k = b.k GROUP BY ALL)
SELECT label::BIGINT AS label, round(pow(sum(c) FILTER (i = j), 2) / nullif(sum(c * c), 0), 6) AS ratio FROM c GROUP BY label""")
def participation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "embedding")
    return R.vector_participation_ratio(e, ["label"], "embedding").select("label", *_r("ratio"))


_ANGLE = f"(neuron % 16) * {2 * math.pi / 16!r}::DOUBLE"
_VEC = _BINS + f""", pv AS (SELECT arm, bin, sqrt(pow(sum(n * cos({_ANGLE})), 2) + pow(sum(n * sin({_ANGLE})), 2)) / sum(n) AS amplitude, atan2(sum(n * sin({_ANGLE})), sum(n * cos({_ANGLE}))) AS angle FROM bi GROUP BY 1, 2),
st AS (SELECT *, angle - lag(angle) OVER (PARTITION BY arm ORDER BY bin) AS raw FROM pv),
un AS (SELECT *, sum(CASE WHEN raw IS NULL THEN angle ELSE raw - 2 * pi() * floor((raw + pi()) / (2 * pi())) END) OVER (PARTITION BY arm ORDER BY bin) AS unwrapped FROM st)"""


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.population_vector(_bins(spark, sf_dir), ["arm", "bin"], (F.col("neuron") % 16) * (2 * math.pi / 16))
    return R.unwrapped(v, ["arm"], "angle")


@query(f"WITH {_VEC} SELECT arm, bin, round(amplitude, 6) AS amplitude, round(angle, 6) AS angle, round(unwrapped, 6) AS unwrapped FROM un")
def population_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir).select("arm", "bin", *_r("amplitude", "angle", "unwrapped"))


@query()
def ring_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm, the bump's mean amplitude in the plane that the users' places lie in."""
    from .fixtures import coords

    return R.bump(_bins(spark, sf_dir), R.plane_angles(coords(spark, sf_dir).withColumnRenamed("id", "neuron")), ["arm"]).select("arm", "bins", *_r("amplitude"))


@query(f"""WITH {_VEC}, f AS (SELECT arm, count(*) AS n, covar_pop(bin, unwrapped) / nullif(var_pop(bin), 0) AS slope, var_pop(unwrapped) AS vy, covar_pop(bin, unwrapped) AS c, avg(bin) AS mx, avg(unwrapped) AS my FROM un GROUP BY arm),
re AS (SELECT arm, bin, unwrapped - my - slope * (bin - mx) AS r FROM un JOIN f USING (arm)), lg AS (SELECT *, lag(r) OVER (PARTITION BY arm ORDER BY bin) AS b FROM re)
SELECT arm, any_value(n) AS n, round(any_value(slope), 6) AS slope, round(abs(any_value(slope)), 6) AS gain, round(any_value(sqrt(greatest(0, vy - slope * c))), 6) AS rms, round(sqrt(avg(r * r)), 6) AS diffusion, round(sum(r * b) / nullif(sum(r * r), 0), 6) AS ac1 FROM lg JOIN f USING (arm) GROUP BY arm""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector(spark, sf_dir)
    return R.affine_fit(v, ["arm"], "bin", "unwrapped").join(R.residual_persistence(v, ["arm"], "bin", "unwrapped"), "arm").select("arm", "n", *_r("slope", "gain", "rms", "diffusion", "ac1"))


@query(f"""WITH {_SERIES}, tu AS (SELECT bi.arm, neuron, covar_pop(x, n) / nullif(var_pop(x), 0) AS slope FROM bi JOIN se USING (arm, bin) GROUP BY 1, 2)
SELECT arm, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN covar_samp(slope, w) / nullif(stddev_samp(slope) * stddev_samp(w), 0) END, 6) AS r, round(avg(abs(slope)), 6) AS mean_abs
FROM (SELECT arm, slope, (neuron % 7)::DOUBLE AS w FROM tu WHERE slope IS NOT NULL) GROUP BY arm""")
def tuning_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bins(spark, sf_dir)
    slopes = R.tuning_slopes(b.join(_series(spark, sf_dir), ["arm", "bin"]), ["arm", "neuron"], "x", "n")
    wiring = b.select("neuron").distinct().withColumn("w", (F.col("neuron") % 7).cast("double"))
    return R.slope_wiring(slopes, wiring, ["arm"]).select("arm", "n", *_r("r", "mean_abs"))


_FREQ = "SELECT arm, sqrt(re * re + im * im) AS amplitude, atan2(im, re) AS phase FROM (SELECT arm, sum({0} * cos(bin * {1!r}::DOUBLE)) * 2 / count(*) AS re, sum({0} * sin(bin * {1!r}::DOUBLE)) * 2 / count(*) AS im FROM {2} GROUP BY arm)"


@query(f"""WITH {_SERIES}, a AS ({_FREQ.format('x', 2 * math.pi * 0.25 * 0.5, 'se')}), cm AS (SELECT arm, bin, sin(bin * 0.7) AS x FROM se), b AS ({_FREQ.format('x', 2 * math.pi * 0.25 * 0.5, 'cm')})
SELECT a.arm, round(a.amplitude, 6) AS amplitude, round(a.phase, 6) AS phase, round(a.amplitude / b.amplitude, 6) AS gain, round(degrees(a.phase - b.phase), 6) AS lag_deg FROM a JOIN b USING (arm)""")
def frequency_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    a = R.frequency_component(s, ["arm"], "x", 0.5, 0.25)
    b = R.frequency_component(s.withColumn("x", F.sin(F.col("bin") * 0.7)), ["arm"], "x", 0.5, 0.25)
    return a.join(R.response(a, b, ["arm"]), "arm").select("arm", *_r("amplitude", "phase", "gain", "lag_deg"))


@query(f"""WITH {SPIKES}, c AS (SELECT arm, neuron, count(*) FILTER (trial % 2 = 0)::DOUBLE AS r, count(*) FILTER (trial % 2 = 1)::DOUBLE AS l, (neuron % 5 - 2)::DOUBLE AS w FROM sk GROUP BY 1, 2)
SELECT arm, round((sum(w * r) - sum(w * l)) / nullif(abs(sum(w * r)) + abs(sum(w * l)), 0), 6) AS projection, round(covar_samp(r - l, w) FILTER (r + l > 0.5) / nullif(stddev_samp(r - l) FILTER (r + l > 0.5) * stddev_samp(w) FILTER (r + l > 0.5), 0), 6) AS wiring_r,
round(covar_samp(r, l) / nullif(stddev_samp(r) * stddev_samp(l), 0), 6) AS side_r, round(avg((r - l) / nullif(r + l, 0)), 6) AS selectivity, count(*) FILTER (r + l > 0.5) AS active FROM c GROUP BY arm""")
def direction_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spikes(spark, sf_dir).groupBy("arm", "neuron").agg(F.count_if(F.col("trial") % 2 == 0).cast("double").alias("r"), F.count_if(F.col("trial") % 2 == 1).cast("double").alias("l"))
    c = c.withColumn("w", (F.col("neuron") % 5 - 2).cast("double"))
    return R.direction_index(c, ["arm"]).select("arm", *_r("projection", "wiring_r", "side_r", "selectivity"), "active")


@query(f"""WITH {SPIKES}, s AS (SELECT arm, floor(t / {DAY})::BIGINT AS bin, count(*) FILTER (neuron % 2 = 0)::DOUBLE AS l, count(*) FILTER (neuron % 2 = 1)::DOUBLE AS r FROM sk GROUP BY 1, 2)
SELECT arm, round(avg(l) / 2, 6) AS rate_l, round(avg(r) / 2, 6) AS rate_r, round(stddev_samp(r - l) / 2, 6) AS asym_sd, round(covar_samp(r - l, sin(bin)) / nullif(stddev_samp(r - l) * stddev_samp(sin(bin)), 0), 6) AS command_r FROM s GROUP BY arm""")
def steering_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spikes(spark, sf_dir).groupBy("arm", F.floor(F.col("t") / DAY).alias("bin")).agg(F.count_if(F.col("neuron") % 2 == 0).cast("double").alias("left"), F.count_if(F.col("neuron") % 2 == 1).cast("double").alias("right"))
    return R.steering(s.withColumn("command", F.sin("bin")), ["arm"], 2.0).select("arm", *_r("rate_l", "rate_r", "asym_sd", "command_r"))


_STEP = "st AS (SELECT trial, step FROM (SELECT unnest(range(3)) AS trial), (SELECT unnest(range({0})) AS step))"
_U = "(('0x' || substr(md5(concat_ws('|', '{0}', {1})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_X = f"""xs AS (SELECT trial, step, greatest(0.05, least(1, 0.45 + 0.3 * sin({2 * math.pi * 0.7!r}::DOUBLE * (step * 0.0005::DOUBLE)) + 0.1 * sin({2 * math.pi * 2.3!r}::DOUBLE * (step * 0.0005::DOUBLE) + 1.1) + 0.08 * ({_U.format('sig', 'trial, step')} - 0.5))) AS x FROM st)"""


def _signal(spark: SparkSession, count: int) -> DataFrame:
    return S.signal(S.steps(spark, 3, count), 0.0005, "sig")


@query(f"WITH {_STEP.format(3000)}, {_X} SELECT trial, step, round(x, 9) AS x FROM xs")
def stimulus_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, 3000).select("trial", "step", *_r("x", digits=9))


@query(f"""WITH {_STEP.format(2100)}, {_X}, bl AS (SELECT trial, b, row_number() OVER (PARTITION BY trial ORDER BY md5(concat_ws('|', 'blk', trial, b))) - 1 AS to_ FROM (SELECT unnest(range(3)) AS trial), (SELECT unnest(range(10)) AS b)),
sh AS (SELECT xs.trial, coalesce(to_, step // 200) * 200 + step % 200 AS step, x AS shuffled FROM xs LEFT JOIN bl ON bl.trial = xs.trial AND b = step // 200)
SELECT trial, step, round(x, 9) AS x, round(shuffled, 9) AS shuffled, round(x + 0.3 * (shuffled - x), 9) AS blend FROM xs JOIN sh USING (trial, step)""")
def block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.block_shuffled(_signal(spark, 2100), 200, "blk")
    return s.select("trial", "step", *_r("x", "shuffled", digits=9), F.round(S.blended("x", "shuffled", F.lit(0.3)), 9).alias("blend"))


@query(f"""WITH {_STEP.format(300)}, {_X}, c AS (SELECT *, unnest(range(20)) AS cell FROM xs)
SELECT 'own' AS kind, cell::BIGINT AS cell, count(*) AS n, min(step) AS first_step FROM c WHERE {_U.format('inj', 'trial, step, cell')} < x * 0.5 GROUP BY 2
UNION ALL SELECT 'synchronous', cell::BIGINT, count(*), min(step) FROM c WHERE {_U.format('inj', 'trial, step')} < x * 0.5 GROUP BY 2""")
def bernoulli_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signal(spark, 300)
    one = lambda kind: S.injections(s, 20, "x", 0.5, "inj", kind == "synchronous").groupBy(F.lit(kind).alias("kind"), F.col("cell").cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"))
    return one("own").unionByName(one("synchronous"))


_CELLS = f"{_STEP.format(120)}, {_X}, ce AS (SELECT *, 0.5 + (step % 7) / 10.0::DOUBLE AS pf, unnest(range(12)) AS cell FROM xs), cp AS (SELECT *, cell < 4 AS in_patch, sin(cell) AS pref, 2 * x - 1 AS yaw, 0.1 * (2 * x - 1) AS py FROM ce)"


def _cells(spark: SparkSession) -> DataFrame:
    c = _signal(spark, 120).withColumn("patch_flow", 0.5 + (F.col("step") % 7) / 10.0).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return c.withColumns({"in_patch": F.col("cell") < 4, "pref": F.sin("cell"), "yaw": 2 * F.col("x") - 1, "patch_yaw": 0.1 * (2 * F.col("x") - 1)}).withColumnRenamed("x", "flow")


_FLOW = _CELLS + """, lv AS (SELECT trial, step, cell, in_patch, x, CASE WHEN in_patch THEN 0.1 * pf * cap ELSE greatest(0, (12 * x - 4 * 0.1 * pf * cap) / 8) END AS level FROM (SELECT *, CASE WHEN 4 * 0.1 * pf > 12 * x THEN 12 * x / (4 * 0.1 * pf) ELSE 1 END AS cap FROM cp))"""


@query(f"""WITH {_FLOW} SELECT trial, round(sum(level) FILTER (in_patch) / sum(level), 6) AS share, round(avg(level) FILTER (in_patch) / avg(level) FILTER (NOT in_patch), 6) AS ratio,
CASE WHEN coalesce(avg(level) FILTER (in_patch) / avg(level) FILTER (NOT in_patch), 0) <= 0 THEN 'no patch' WHEN avg(level) FILTER (in_patch) / avg(level) FILTER (NOT in_patch) < 0.5 THEN 'below natural' WHEN avg(level) FILTER (in_patch) / avg(level) FILTER (NOT in_patch) < 0.9 THEN 'partly below natural' ELSE 'not below natural' END AS verdict FROM lv GROUP BY trial""")
def manipulation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.manipulation(S.flow_levels(_cells(spark)), ["trial"]).select("trial", *_r("share", "ratio"), "verdict")


@query(f"""WITH {_CELLS}, na AS (SELECT *, 0.88 * greatest(0, pref * yaw) AS nat, 0.88 * greatest(0, pref * py) AS pat FROM cp),
su AS (SELECT trial, step, sum(nat) AS target, sum(pat) FILTER (in_patch) AS got, sum(nat) FILTER (NOT in_patch) AS outside FROM na GROUP BY 1, 2),
lv AS (SELECT na.trial, na.step, in_patch, 0.12 + CASE WHEN outside < 1e-6 THEN 0 WHEN in_patch THEN pat * cap ELSE nat * greatest(0, (target - got * cap) / nullif(outside, 0)) END AS level FROM na JOIN (SELECT *, CASE WHEN got > target AND got > 1e-9 THEN target / got ELSE 1 END AS cap FROM su) s USING (trial, step))
SELECT trial, step, round(sum(level), 6) AS total, round(sum(level) FILTER (in_patch), 6) AS patch FROM lv GROUP BY 1, 2""")
def yaw_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.yaw_levels(_cells(spark)).groupBy("trial", "step").agg(F.round(F.sum("level"), 6).alias("total"), F.round(F.sum(F.when(F.col("in_patch"), F.col("level"))), 6).alias("patch"))


@query(f"""WITH {_FLOW}, ev AS (SELECT arm, trial, count(*) FILTER ({_U.format('drv', 'arm, trial, step, cell')} < level * f)::DOUBLE AS events, sum(level * f) AS expected FROM lv, (VALUES ('self', 1.0::DOUBLE), ('half', 0.5::DOUBLE)) a(arm, f) GROUP BY 1, 2),
s AS (SELECT arm, avg(events) AS m, avg(expected) AS e, stddev_samp(events) AS sd FROM ev GROUP BY 1)
SELECT arm, round(m, 6) AS delivered_mean, round(m / (SELECT m FROM s WHERE arm = 'self'), 6) AS ratio, round(e, 6) AS expected, round(sd, 6) AS delivered_sd FROM s""")
def drive_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from axonframe.functions.rng import uniform

    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(f).alias("f")) for a, f in (("self", 1.0), ("half", 0.5))]))
    d = S.flow_levels(_cells(spark)).withColumn("a", arms).withColumn("arm", F.col("a.arm")).withColumn("p", F.col("level") * F.col("a.f"))
    e = d.groupBy("arm", "trial").agg(F.count_if(uniform("drv", "arm", "trial", "step", "cell") < F.col("p")).cast("double").alias("events"), F.sum("p").alias("expected"))
    return R.drive_matching(e, "self").select("arm", *_r("delivered_mean", "ratio", "expected", "delivered_sd"))


@query(f"""WITH {_SERIES}, b AS (SELECT arm, avg(x) AS base_mean, stddev_samp(x) AS base_sd FROM se WHERE bin < 10 GROUP BY 1), p AS (SELECT *, bin - 10 AS st FROM se JOIN b USING (arm) WHERE bin >= 10)
SELECT arm, round(any_value(base_mean), 6) AS base_mean, round(any_value(base_sd), 6) AS base_sd, max(x) AS peak, arg_max(st, x * 1000 - st) AS peak_step, min(st) FILTER (x > base_mean + 1.2 * base_sd) AS latency, round(sum(x) FILTER (st < 8) - any_value(base_mean) * 8, 6) AS excess FROM p GROUP BY arm""")
def volley_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir).select("arm", F.col("bin").alias("step"), F.col("x").alias("n"))
    return R.volley(s, ["arm"], 10, 8, 1.2).select("arm", *_r("base_mean", "base_sd"), "peak", "peak_step", "latency", *_r("excess"))


@query(f"WITH {SPIKES} SELECT arm, count(DISTINCT neuron) AS responders FROM sk WHERE t >= 0 AND t < {DAY * 2} GROUP BY arm")
def volley_responders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.responders(spikes(spark, sf_dir), ["arm"], 0.0, DAY * 2)


@query("""SELECT * FROM (VALUES ('rest', 0::BIGINT, false, 'none', 0.0::DOUBLE, 1.0::DOUBLE, false), ('flow', 1, true, 'none', 0.0, 1.0, false), ('self', 2, true, 'body', 0.0, 1.0, false), ('shuffle', 3, true, 'random', 0.0, 1.0, false),
('randmat', 4, true, 'matched', 0.0, 1.0, false), ('decorr', 5, true, 'body', 1.0, 1.0, false), ('conf25', 6, true, 'body', 0.25, 1.0, false), ('conf50', 7, true, 'body', 0.5, 1.0, false),
('conf75', 8, true, 'body', 0.75, 1.0, false), ('drive0.5', 9, true, 'none', 0.0, 0.5, false), ('drive1.5', 10, true, 'none', 0.0, 1.5, false), ('synch', 11, true, 'none', 0.0, 1.0, true)) a(arm, ord, driven, patch, alpha, drive, synch)""")
def arm_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve arms."""
    return S.all_arms(spark)


@query()
def ring_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.binned(spikes(spark, sf_dir).withColumn("cell", F.col("neuron") % 50), ["arm", "cell"], DAY, 0.0, SPAN)
    return R.ring_trajectory(b, ["arm"], 50, DAYS)


def _circuit(spark: SparkSession, sf_dir: str) -> tuple[CircuitTable, DataFrame, int]:
    """A neuron for each user, numbered in the order of ids; edges between consecutive events; every fifth user is inhibitory. Neither users nor edges come to the driver."""
    g = event_graph(spark, sf_dir).groupBy("pre", "post").agg(F.sum("w").alias("w")).withColumn("w", F.when(F.col("pre") % 5 == 0, -F.col("w")).otherwise(F.col("w")) * 0.275 / 10)
    g = stored(g, "graph")
    ends = g.select(F.col("pre").alias("id")).union(g.select("post")).distinct()
    index = stored(prefix_sums(ends, "id", {"k": F.lit(1)}).select((F.col("k") - 1).alias("k"), "id"), "neurons")
    n = index.count()
    number = lambda side: index.select(F.col("k").alias(f"{side}_k"), F.col("id").alias(side))
    e = stored(g.join(number("pre"), "pre").join(number("post"), "post").select(F.col("pre_k").alias("pre"), F.col("post_k").alias("post"), "w"), "edges")
    return CircuitTable(packed(e), n), e, n


def _part(n: int, start: float, stop: float) -> np.ndarray:
    """The neurons from one share of a circuit to another, one at least."""
    return np.arange(min(round(n * start), n - 1), max(round(n * stop), round(n * start) + 1))


POPULATIONS = 8


def _populations(spark: SparkSession, n: int) -> DataFrame:
    """``neuron, population``: eighths of the circuit; the first four can be driven."""
    return spark.range(n).select(F.col("id").alias("neuron"), F.floor(F.col("id") * POPULATIONS / n).cast("long").alias("population"))


@query()
def lif_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, n = _circuit(spark, sf_dir)
    plan = X.planned(spark, [("rest", 0.0, 0.0, 1.0, 0.0), ("self", 0.6, 0.0, 1.0, 0.0), ("flow", 0.6, 0.25, 1.0, 0.0), ("loop", 0.6, 0.0, 1.0, 0.5)], 3)
    s = spikes_only(run_trials(plan, c, _part(n, 0, 0.2), 1.0, resting=2.0, loop_sides=(_part(n, 0.5, 0.75), _part(n, 0.75, 1))))
    return s.groupBy("arm", "trial").agg(F.count(F.lit(1)).alias("spikes"), F.countDistinct("neuron").alias("active"), (F.count(F.lit(1)) / F.lit(float(n))).alias("rate_hz"))


@query()
def dose_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dose of the patch, a row a share and trial."""
    c, _, n = _circuit(spark, sf_dir)
    return X.dose(spark, c, _part(n, 0, 0.2), [0.0, 0.25, 0.5, 1.0], 2, 0.5)


@query()
def gain_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scale of the weights and population."""
    c, e, n = _circuit(spark, sf_dir)
    return X.gain_sweep(c, e, _populations(spark, n), _part(n, 0, 0.2), [0.5, 1.0, 2.0], 0.5)


@query()
def steady_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steady rotation to either side."""
    c, _, n = _circuit(spark, sf_dir)
    return X.steady_direction(spark, c, _populations(spark, n), _part(n, 0, 0.2), 0.5)


@query()
def scenario_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five scenarios of one second, four pools driven at rates of their own."""
    c, _, n = _circuit(spark, sf_dir)
    return X.scenarios(c, _populations(spark, n), {name: _part(n, k / POPULATIONS, (k + 1) / POPULATIONS) for k, name in enumerate(("smell", "taste", "danger", "view"))})
