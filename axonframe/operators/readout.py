"""Readouts of spike tables ``arm, trial, neuron, t``: rates, bins, correlations, time constants, dimensionality, tuning.

Empty bins and silent trials count as zeros without being made: moments over a known number of bins follow from sums
over the bins that have spikes. Spines are built only for series over time, one value a bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from axonframe.functions.exprs import prefix_sums, ratio, safe_corr, safe_slope, wrap_angle
from axonframe.functions.rng import hash_key, uniform


def firing_rates(spikes: DataFrame, seconds: float, runs: int, arm: str = "arm") -> DataFrame:
    """``arm, neuron, rate, sd``: mean and population deviation over a fixed number of runs; a run without a spike is 0."""
    per_run = spikes.groupBy(arm, "neuron", "trial").agg((F.count(F.lit(1)) / F.lit(seconds)).alias("r"))
    out = per_run.groupBy(arm, "neuron").agg((F.sum("r") / runs).alias("rate"), (F.sum(F.col("r") * F.col("r")) / runs).alias("sq"))
    return out.select(arm, "neuron", "rate", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("rate") * F.col("rate"))).alias("sd"))


def rate_table(rates: DataFrame, names: DataFrame, arms: list[str], arm: str = "arm") -> DataFrame:
    """``neuron, name`` and a rate column for each arm (0 if silent); names that aren't known are blank."""
    wide = rates.groupBy("neuron").pivot(arm, arms).agg(F.first("rate"))
    return wide.join(names, "neuron", "left").select("neuron", F.coalesce("name", F.lit("")).alias("name"), *[F.coalesce(a, F.lit(0.0)).alias(a) for a in arms])


def binned(spikes: DataFrame, by: list[str], width: float, start: float, stop: float) -> DataFrame:
    """``by, bin, n``: spikes in [start, stop) by bins of a width; bins without spikes have no row."""
    inside = spikes.filter((F.col("t") >= start) & (F.col("t") < stop))
    return inside.groupBy(*by, F.floor((F.col("t") - start) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dense_series(bins: DataFrame, by: list[str], count: int) -> DataFrame:
    """One value a bin from 0 to ``count``: the sum over cells, 0 where there is none."""
    spine = bins.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    sums = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return spine.join(sums, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("double").alias("x"))


def activity(spikes: DataFrame, cells: DataFrame, seconds: float, threshold: float) -> DataFrame:
    """``arm, family, cells, mean_rate, active``: by family and (family null) over all, in one pass of grouping sets.

    ``cells``: ``neuron, family``; each cell counts in each arm, also when silent.
    """
    arms = spikes.select("arm").distinct()
    counts = spikes.groupBy("arm", "neuron").agg(F.count(F.lit(1)).alias("n"))
    members = cells.groupBy("family").agg(F.count(F.lit(1)).alias("cells"))
    fired = counts.join(cells, "neuron").withColumn("rate", F.col("n") / F.lit(seconds))
    sums = fired.groupBy("arm", "family").agg(F.sum("rate").alias("rate"), F.count_if(F.col("rate") > threshold).alias("active"))
    every = members.withColumn("arm", F.explode(F.array(*[F.lit(r.arm) for r in arms.orderBy("arm").collect()])))  # arms are a handful of names
    joined = every.join(sums, ["arm", "family"], "left")
    out = joined.groupingSets([["arm", "family"], ["arm"]], "arm", "family").agg(F.sum("cells").alias("cells"), F.sum(F.coalesce("rate", F.lit(0.0))).alias("rate"), F.sum(F.coalesce("active", F.lit(0))).alias("active"))
    return out.select("arm", "family", "cells", (F.col("rate") / F.col("cells")).alias("mean_rate"), (F.col("active") / F.col("cells")).alias("active"))


def bin_moments(bins: DataFrame, by: list[str], count: int) -> DataFrame:
    """``by, total, mean, sd``: over ``count`` bins, empty ones included (sample deviation)."""
    s = bins.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    mean = F.col("total") / F.lit(float(count))
    return s.select(*by, "total", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("sq") - count * mean * mean) / (count - 1))).alias("sd"))


def z_scores(bins: DataFrame, by: list[str], count: int, floor: float = 1e-6) -> DataFrame:
    """z of each bin that has spikes: (n - mean) / (sd + floor)."""
    return bins.join(bin_moments(bins, by, count), by).withColumn("z", (F.col("n") - F.col("mean")) / (F.col("sd") + floor))


def population_deviation(bins: DataFrame, by: list[str], cells: int, count: int, width: float) -> DataFrame:
    """``by, mean_rate, sd_rate``: of the population's mean rate over bins (population deviation, empty bins are 0)."""
    per_bin = bins.groupBy(*by, "bin").agg((F.sum("n") / F.lit(cells * width)).alias("r"))
    s = per_bin.groupBy(*by).agg((F.sum("r") / count).alias("mean_rate"), (F.sum(F.col("r") * F.col("r")) / count).alias("sq"))
    return s.select(*by, "mean_rate", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean_rate") ** 2)).alias("sd_rate"))


#: Draws of :func:`distinct_pairs`: 300 of the 325 pairs of 26 cells, the tightest case, take some 900.
PAIR_DRAWS = 20000


def distinct_pairs(cells: DataFrame, pairs: int, seed: str, draws: int = PAIR_DRAWS) -> DataFrame:
    """``pair, a, b``: min(pairs, n (n - 1) / 2) distinct pairs of n distinct cells; a cell may be in several.

    If there are no more pairs than that, all of them. Else each draw takes two cells by hash, and the first
    distinct pairs count; the number of draws doesn't depend on the input.
    """
    number = prefix_sums(cells.select("neuron"), "neuron", {"k": F.lit(1)}).select("neuron", (F.col("k") - 1).cast("long").alias("k"))
    n = cells.count()
    if n * (n - 1) // 2 <= pairs:
        chosen = number.select(F.col("neuron").alias("a")).join(number.select(F.col("neuron").alias("b")), F.col("a") < F.col("b")).withColumn("j", F.lit(0))
    else:
        pick = lambda side: F.floor(uniform(seed, "j", F.lit(side)) * n)
        drawn = cells.sparkSession.range(1, draws + 1).withColumnRenamed("id", "j").select("j", pick("a").alias("x"), pick("b").alias("y")).filter("x <> y")
        drawn = drawn.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("j").alias("j")).orderBy("j").limit(pairs)
        side = lambda k, name: number.select(F.col("k").alias(k), F.col("neuron").alias(name))
        chosen = drawn.join(side("x", "a"), "x").join(side("y", "b"), "y")
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("j", "a", "b")) - 1
    return chosen.select(nth.cast("long").alias("pair"), "a", "b")


def pair_correlations(bins: DataFrame, pairs: DataFrame, count: int) -> DataFrame:
    """``arm, pair, r`` over ``count`` bins: products are summed over the bins where both fired; null for a constant cell."""
    both = pairs.select("pair", F.explode(F.array(F.struct(F.col("a").alias("neuron"), F.lit(0).alias("side")), F.struct(F.col("b").alias("neuron"), F.lit(1).alias("side")))).alias("s")).select("pair", "s.neuron", "s.side")
    rows = bins.join(both, "neuron")
    met = rows.groupBy("arm", "pair", "bin").agg(F.count(F.lit(1)).alias("c"), F.product("n").alias("xy")).groupBy("arm", "pair").agg(F.sum(F.when(F.col("c") == 2, F.col("xy")).otherwise(0.0)).alias("xy"))
    m = rows.groupBy("arm", "pair").agg(*[f(F.when(F.col("side") == k, F.col("n"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("s", F.sum), ("q", lambda c: F.sum(c * c)))])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    sd = lambda k: F.sqrt(F.greatest(F.lit(0.0), (z(f"q{k}") - z(f"s{k}") * z(f"s{k}") / count) / (count - 1)))
    r = ratio((z("xy") - z("s0") * z("s1") / count) / (count - 1), sd(0) * sd(1))
    return met.join(m, ["arm", "pair"]).select("arm", "pair", r.alias("r"))


def autocorrelation_time(series: DataFrame, by: list[str], width: float, most: int, include_zero: bool = True, cutoff: float | None = None) -> DataFrame:
    """``by, tau``: the sum of max(0, acf) over lags up to ``most`` times the bin width.

    ``include_zero``: lag 0 counts; ``cutoff``: only lags before the first acf under it. Null for a constant series.
    """
    w = W.partitionBy(*by)
    d = series.withColumn("x", F.col("x") - F.avg("x").over(w))
    d = d.withColumn("v", F.sum(F.col("x") * F.col("x")).over(w))
    lagged = d.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).select(*by, "lag", (F.col("bin") + F.col("lag")).alias("bin"), F.col("x").alias("y"))
    acf = d.join(lagged, [*by, "bin"]).groupBy(*by, "lag").agg(ratio(F.sum(F.col("x") * F.col("y")), F.max("v")).alias("acf"))
    if not include_zero:
        acf = acf.filter("lag > 0")
    if cutoff is not None:
        low = F.min(F.when(F.col("acf") < cutoff, F.col("lag"))).over(w)
        acf = acf.withColumn("low", low).filter("low is null or lag < low")
    return acf.groupBy(*by).agg((F.sum(F.when(F.col("acf").isNotNull(), F.greatest(F.lit(0.0), F.col("acf")))) * width).alias("tau"))


def participation_ratio(df: DataFrame, by: list[str], columns: list[Column]) -> DataFrame:
    """``by, ratio`` = trace(C)^2 / |C|^2 of the columns' covariance: (sum of eigenvalues)^2 / sum of squares, without any eigenvalue."""
    named = df.select(*by, *[c.cast("double").alias(f"_d{k}") for k, c in enumerate(columns)])
    n = len(columns)
    s = named.groupBy(*by).agg(*[F.covar_pop(f"_d{i}", f"_d{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)])
    trace = sum((F.col(f"c{i}_{i}") for i in range(n)), F.lit(0.0))
    norm = sum(((1 if i == j else 2) * F.col(f"c{i}_{j}") * F.col(f"c{i}_{j}") for i in range(n) for j in range(i, n)), F.lit(0.0))
    return s.select(*by, ratio(trace * trace, norm).alias("ratio"))


def vector_participation_ratio(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """:func:`participation_ratio` over all components of an array column; their number comes from the data.

    Each task gives count, mean and centred products of its rows by group; those few rows are then put together, so
    that no row is multiplied out into pairs of components. Rows with a null vector or component are left out; vectors
    of unequal length in a group are refused.
    """
    sent = df.schema
    keys = StructType([sent[c] for c in by])
    partial = StructType([*keys, StructField("n", LongType()), StructField("mean", ArrayType(DoubleType())), StructField("m2", ArrayType(DoubleType()))])

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        if len(a[1]) != len(b[1]):
            raise ValueError(f"vectors of {len(a[1])} and {len(b[1])} components in one group")
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for key, g in batch.groupby(by, dropna=False, sort=False):
                sizes = {len(v) for v in g[vector]}
                if len(sizes) > 1:
                    raise ValueError(f"vectors of {min(sizes)} and {max(sizes)} components in one group")
                x = np.stack(g[vector].to_list()).astype(float)
                mean = x.mean(0)
                key = tuple(None if pd.isna(k) else k for k in key)
                held[key] = merged(held.get(key), (len(x), mean, (x - mean).T @ (x - mean)))
        if held:
            yield pd.DataFrame([(*k, n, m.tolist(), c.ravel().tolist()) for k, (n, m, c) in held.items()], columns=[*by, "n", "mean", "m2"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, m, c in zip(g["n"], g["mean"], g["m2"], strict=True):
            total = merged(total, (n, np.asarray(m), np.asarray(c).reshape(len(m), len(m))))
        norm = float((total[2] ** 2).sum())
        return g[by].head(1).assign(ratio=float(np.trace(total[2]) ** 2 / norm) if norm else None)

    good = df.select(*by, vector).filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull()))
    return good.mapInPandas(parts, partial).groupBy(*by).applyInPandas(whole, StructType([*keys, StructField("ratio", DoubleType())]))


def population_vector(bins: DataFrame, by: list[str], angle: Column) -> DataFrame:
    """``by, amplitude, angle`` of the spike-weighted mean direction; null without spikes."""
    s = bins.groupBy(*by).agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.cos(angle)).alias("c"), F.sum(F.col("n") * F.sin(angle)).alias("s"))
    return s.select(*by, ratio(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), "w").alias("amplitude"), F.atan2("s", "c").alias("angle"))


def plane_angles(points: DataFrame) -> DataFrame:
    """``neuron, angle``: each point's angle in the plane of the two principal axes of all (``neuron, x, y, z``), around their centre.

    Only sums of coordinates and their products come to the driver. An axis's sign is free: its largest part is positive.
    """
    products = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    m = points.agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in products]).first()
    if m["x"] is None:
        return points.select("neuron", F.lit(None).cast("double").alias("angle"))
    cov = np.array([[m["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    along = [sum(((F.col(c) - F.lit(m[c])) * float(axes[k, j]) for k, c in enumerate("xyz")), F.lit(0.0)) for j in (0, 1)]
    return points.select("neuron", F.atan2(along[1], along[0]).alias("angle"))


def bump(bins: DataFrame, angles: DataFrame, by: list[str]) -> DataFrame:
    """``by, bins, amplitude``: the mean over bins with spikes of the resultant's length in the plane of :func:`plane_angles`."""
    v = population_vector(bins.join(angles, "neuron"), [*by, "bin"], F.col("angle"))
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("bins"), F.avg("amplitude").alias("amplitude"))


def unwrapped(series: DataFrame, by: list[str], angle: str) -> DataFrame:
    """``series`` with ``unwrapped``: the first angle plus the wrapped steps since then, in the order of bins."""
    w = W.partitionBy(*by).orderBy("bin")
    step = F.coalesce(wrap_angle(F.col(angle) - F.lag(angle).over(w)), F.col(angle))
    return series.withColumn("_step", step).withColumn("unwrapped", F.sum("_step").over(w)).drop("_step")


def affine_fit(points: DataFrame, by: list[str], x: str, y: str, least: int = 8) -> DataFrame:
    """``by, n, slope, gain, rms``: the least-squares line, |slope|, and the root mean square of its residuals; null under ``least`` points."""
    s = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_slope(x, y).alias("slope"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    good = F.col("n") >= least
    return s.select(*by, "n", F.when(good, F.col("slope")).alias("slope"), F.when(good, F.abs("slope")).alias("gain"), F.when(good, F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.col("slope") * F.col("cxy")))).alias("rms"))


def residual_persistence(series: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, diffusion, ac1``: deviation of y around its line over x, and the residuals' lag-1 autocorrelation."""
    w = W.partitionBy(*by)
    m = series.withColumn("_mx", F.avg(x).over(w)).withColumn("_my", F.avg(y).over(w))
    line = m.groupBy(*by).agg(safe_slope(x, y).alias("slope"), F.first("_mx").alias("mx"), F.first("_my").alias("my"))
    r = series.join(line, by).withColumn("r", F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx")))
    r = r.withColumn("before", F.lag("r").over(w.orderBy("bin")))
    return r.groupBy(*by).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("diffusion"), ratio(F.sum(F.col("r") * F.col("before")), F.sum(F.col("r") * F.col("r"))).alias("ac1"))


def frequency_component(series: DataFrame, by: list[str], value: str, width: float, hertz: float) -> DataFrame:
    """``by, amplitude, phase`` of one sinusoid in an evenly binned series."""
    w = F.col("bin") * (2 * math.pi * hertz * width)
    s = series.groupBy(*by).agg((F.sum(F.col(value) * F.cos(w)) * 2 / F.count(F.lit(1))).alias("re"), (F.sum(F.col(value) * F.sin(w)) * 2 / F.count(F.lit(1))).alias("im"))
    return s.select(*by, F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amplitude"), F.atan2("im", "re").alias("phase"))


def response(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``by, gain, lag_deg`` of component a against b; null where b has no amplitude."""
    j = a.select(*by, F.col("amplitude").alias("aa"), F.col("phase").alias("pa")).join(b.select(*by, F.col("amplitude").alias("ab"), F.col("phase").alias("pb")), by)
    on = F.col("ab") > 1e-9
    return j.select(*by, F.when(on, F.col("aa") / F.col("ab")).alias("gain"), F.when(on, F.degrees(F.col("pa") - F.col("pb"))).alias("lag_deg"))


def tuning_slopes(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, slope`` of y on a covariate; null for a constant one."""
    return points.groupBy(*by).agg(safe_slope(x, y).alias("slope"))


def slope_wiring(slopes: DataFrame, wiring: DataFrame, by: list[str], least: int = 8) -> DataFrame:
    """``by, n, r, mean_abs``: correlation of tuning slopes with a wiring weight; null under ``least`` cells or without variance."""
    j = slopes.join(wiring, "neuron").filter("slope is not null")
    s = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr("slope", "w").alias("r"), F.avg(F.abs("slope")).alias("mean_abs"))
    return s.select(*by, "n", F.when(F.col("n") >= least, F.col("r")).alias("r"), "mean_abs")


def direction_index(cells: DataFrame, by: list[str]) -> DataFrame:
    """Of ``by, r, l, w`` (a cell's activity either way, its weight): projection index, wiring and side correlations, selectivity, active cells."""
    total = F.col("r") + F.col("l")
    dr, dl = F.sum(F.col("w") * F.col("r")), F.sum(F.col("w") * F.col("l"))
    on = F.when(total > 0.5, F.lit(1))
    return cells.groupBy(*by).agg(
        ratio(dr - dl, F.abs(dr) + F.abs(dl)).alias("projection"),
        ratio(F.covar_samp(on * (F.col("r") - F.col("l")), on * F.col("w")), F.stddev_samp(on * (F.col("r") - F.col("l"))) * F.stddev_samp(on * F.col("w"))).alias("wiring_r"),
        safe_corr("r", "l").alias("side_r"),
        F.avg(F.when(total >= 0.5, (F.col("r") - F.col("l")) / total)).alias("selectivity"),
        F.count_if(total > 0.5).alias("active"),
    )


def steering(series: DataFrame, by: list[str], width: float) -> DataFrame:
    """Of ``by, bin, left, right, command``: rates of both sides, deviation of their difference, its correlation with the command."""
    d = F.col("right") - F.col("left")
    return series.withColumn("d", d).groupBy(*by).agg((F.avg("left") / width).alias("rate_l"), (F.avg("right") / width).alias("rate_r"), (F.stddev_samp("d") / width).alias("asym_sd"), safe_corr("d", "command").alias("command_r"))


def manipulation(delivered: DataFrame, by: list[str], uniform: Column | None = None) -> DataFrame:
    """Of ``by, in_patch, level``: the patch's share of the drive, patch / surround mean level, and a verdict; groups that are ``uniform`` have no patch by design."""
    p = F.when(F.col("in_patch"), F.col("level"))
    s = F.when(~F.col("in_patch"), F.col("level"))
    out = delivered.groupBy(*by).agg(ratio(F.coalesce(F.sum(p), F.lit(0.0)), F.sum("level")).alias("share"), ratio(F.avg(p), F.avg(s)).alias("ratio"))
    r = F.coalesce("ratio", F.lit(0.0))
    natural = F.lit(False) if uniform is None else uniform
    return out.withColumn("verdict", F.when(natural, "natural").when(r <= 0, "no patch").when(r < 0.5, "below natural").when(r < 0.9, "partly below natural").otherwise("not below natural"))


def drive_matching(delivered: DataFrame, reference: str) -> DataFrame:
    """Of ``arm, trial, events, expected``: mean, ratio to the reference arm, expected mean and deviation of delivered events."""
    s = delivered.groupBy("arm").agg(F.avg("events").alias("delivered_mean"), F.avg("expected").alias("expected"), F.stddev_samp("events").alias("delivered_sd"))
    ref = s.filter(F.col("arm") == reference).select(F.lit(1).alias("k"), F.col("delivered_mean").alias("ref"))
    return s.withColumn("k", F.lit(1)).join(F.broadcast(ref), "k", "left").select("arm", "delivered_mean", ratio("delivered_mean", "ref").alias("ratio"), "expected", "delivered_sd")


def volley(steps: DataFrame, by: list[str], pre: int, window: int = 40, sds: float = 3.0) -> DataFrame:
    """Of ``by, step, n``: baseline mean and deviation, peak and its step, first step over mean + ``sds`` deviations, excess in the window.

    Steps before ``pre`` are the baseline; later ones count from it. Latency is null if none is over the threshold.
    """
    base = steps.filter(F.col("step") < pre).groupBy(*by).agg(F.avg("n").alias("base_mean"), F.stddev_samp("n").alias("base_sd"))
    post = steps.filter(F.col("step") >= pre).withColumn("at", F.col("step") - pre).join(base, by)
    over = F.when(F.col("n") > F.col("base_mean") + sds * F.col("base_sd"), F.col("at"))
    out = post.groupBy(*by, "base_mean", "base_sd").agg(F.max("n").alias("peak"), F.max(F.struct(F.col("n").alias("n"), (-F.col("at")).alias("neg"))).alias("top"), F.min(over).alias("latency"), F.sum(F.when(F.col("at") < window, F.col("n")).otherwise(0)).alias("early"))
    return out.select(*by, "base_mean", "base_sd", "peak", (-F.col("top.neg")).alias("peak_step"), "latency", (F.col("early") - F.col("base_mean") * window).alias("excess"))


def responders(spikes: DataFrame, by: list[str], start: float, stop: float) -> DataFrame:
    """``by, responders``: distinct cells that fired in [start, stop)."""
    return spikes.filter((F.col("t") >= start) & (F.col("t") < stop)).groupBy(*by).agg(F.countDistinct("neuron").alias("responders"))


def ring_trajectory(bins: DataFrame, by: list[str], cells: int, count: int) -> DataFrame:
    """``by, loop, share``: turns of the state's angle in its plane of two principal axes, by bin, and that plane's share of the variance.

    A trial's state is a matrix of ``count`` bins by ``cells`` cells (at most a few hundred each): one group of a grouped map.
    """
    import numpy as np
    import pandas as pd

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((count, cells))
        np.add.at(x, (p["bin"].to_numpy().astype(int), p["cell"].to_numpy().astype(int)), p["n"].to_numpy())
        x -= x.mean(axis=0)
        values, vectors = np.linalg.eigh(x @ x.T)
        total = values.sum()
        a, b = (vectors[:, -k] * np.sqrt(max(values[-k], 0)) for k in (1, 2))
        step = np.diff(np.arctan2(b, a))
        turns = np.abs((step + np.pi) % (2 * np.pi) - np.pi).sum() / (2 * np.pi)
        return pd.DataFrame({**{c: [p[c].iloc[0]] for c in by}, "loop": [turns / count], "share": [values[-2:].sum() / total if total > 0 else None]})

    kinds = dict(bins.dtypes)
    return bins.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", loop double, share double")
