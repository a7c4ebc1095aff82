"""Stimulus series and drive balancing, a row a step; all noise is hashed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions.exprs import clamp, ratio
from axonframe.functions.rng import hash_key, uniform

#: Fixed values of the stimulus: waves (amplitude, Hz, phase), offset, noise amplitude, lowest and highest level.
FLOW_WAVES, FLOW_OFFSET, FLOW_NOISE, FLOW_RANGE = ((0.30, 0.7, 0.0), (0.10, 2.3, 1.1)), 0.45, 0.08, (0.05, 1.0)
HEADING_WAVES, HEADING_OFFSET, HEADING_NOISE, HEADING_RANGE = ((0.5, 0.25, 0.0), (0.3, 0.6, 0.7)), 0.0, 0.12, (-1.0, 1.0)
#: Fixed values of the drive: a body-locked region's share of the world's slip, and the yaw drive's baseline.
BODY_SLIP, YAW_BASELINE = 0.1, 0.12

#: All arms, base, conflict and control: name, driven, patch strategy, share of the shuffled signal, factor of the drive, one draw for all cells.
ALL_ARMS = [
    ("rest", False, "none", 0.0, 1.0, False), ("flow", True, "none", 0.0, 1.0, False), ("self", True, "body", 0.0, 1.0, False), ("shuffle", True, "random", 0.0, 1.0, False),
    ("randmat", True, "matched", 0.0, 1.0, False), ("decorr", True, "body", 1.0, 1.0, False), ("conf25", True, "body", 0.25, 1.0, False), ("conf50", True, "body", 0.5, 1.0, False),
    ("conf75", True, "body", 0.75, 1.0, False), ("drive0.5", True, "none", 0.0, 0.5, False), ("drive1.5", True, "none", 0.0, 1.5, False), ("synch", True, "none", 0.0, 1.0, True),
]


def all_arms(spark: SparkSession) -> DataFrame:
    """``arm, ord, driven, patch, alpha, drive, synch`` of :data:`ALL_ARMS`."""
    return spark.createDataFrame([(n, k, *x) for k, (n, *x) in enumerate(ALL_ARMS)], "arm string, ord long, driven boolean, patch string, alpha double, drive double, synch boolean")


def steps(spark: SparkSession, trials: int, count: int) -> DataFrame:
    """``trial, step``: the spine of a run; trials are rows, steps are generated in the tasks."""
    return spark.range(trials).withColumnRenamed("id", "trial").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))


def signal(spine: DataFrame, dt: float, seed: str, heading: bool = False) -> DataFrame:
    """``spine`` with ``x``: two sinusoids and hashed noise, clamped. The noise's key has no arm: all arms of a trial share it."""
    waves, offset, noise, (lo, hi) = (HEADING_WAVES, HEADING_OFFSET, HEADING_NOISE, HEADING_RANGE) if heading else (FLOW_WAVES, FLOW_OFFSET, FLOW_NOISE, FLOW_RANGE)
    t = F.col("step") * dt
    x = F.lit(offset)
    for amplitude, hertz, phase in waves:
        x = x + amplitude * F.sin(2 * math.pi * hertz * t + phase)
    return spine.withColumn("x", clamp(x + noise * (uniform(seed, "trial", "step") - 0.5), lo, hi))


def block_shuffled(series: DataFrame, block: int, seed: str) -> DataFrame:
    """``series`` with ``shuffled``: whole blocks of a trial in the order of their hashes; a last short block stays where it is."""
    full = series.groupBy("trial").agg((F.floor((F.max("step") + 1) / block)).alias("blocks"))
    blocks = full.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("blocks") - 1)))).filter(F.col("b") < F.col("blocks"))
    to = F.row_number().over(W.partitionBy("trial").orderBy(hash_key(seed, "trial", "b"))) - 1
    moved = blocks.select("trial", "b", to.cast("long").alias("to"))
    src = series.select("trial", F.floor(F.col("step") / block).alias("b"), (F.col("step") % block).alias("k"), F.col("x").alias("shuffled"))
    src = src.join(moved, ["trial", "b"], "left").select("trial", (F.coalesce("to", "b") * block + F.col("k")).alias("step"), "shuffled")
    return series.join(src, ["trial", "step"])


def blended(own: Column | str, other: Column | str, alpha: Column | str) -> Column:
    """(1 - alpha) * own + alpha * other."""
    own, other, alpha = (F.col(c) if isinstance(c, str) else c for c in (own, other, alpha))
    return own + alpha * (other - own)


def injections(spine: DataFrame, cells: int, rate: Column | str, dt: float, seed: str, synchronous: bool = False) -> DataFrame:
    """``spine`` rows by cell where a Bernoulli draw of probability rate * dt hits. ``synchronous``: one draw a step for all cells."""
    rate = F.col(rate) if isinstance(rate, str) else rate
    each = spine.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    key = ["trial", "step"] if synchronous else ["trial", "step", "cell"]
    return each.filter(uniform(seed, *key) < rate * dt)


def flow_levels(delivered: DataFrame, slip: float = BODY_SLIP) -> DataFrame:
    """Of ``trial, step, cell, in_patch, flow, patch_flow``: ``level`` so that each step's total is cells * flow exactly.

    Patch cells get ``slip`` * patch_flow, capped by the budget; the surround shares the rest.
    """
    w = W.partitionBy("trial", "step")
    n, in_patch = F.count(F.lit(1)).over(w), F.sum(F.when(F.col("in_patch"), 1).otherwise(0)).over(w)
    want = F.lit(slip) * F.col("patch_flow")
    patch_sum, budget = in_patch * want, n * F.col("flow")
    cap = F.when((patch_sum > budget) & (patch_sum > 1e-9), budget / F.nullif(patch_sum, F.lit(0.0))).otherwise(1.0)
    rest = F.coalesce(ratio(budget - patch_sum * cap, (n - in_patch).cast("double")), F.col("flow"))
    return delivered.withColumn("level", F.when(F.col("in_patch"), want * cap).otherwise(F.greatest(F.lit(0.0), rest)))


def yaw_levels(delivered: DataFrame, baseline: float = YAW_BASELINE) -> DataFrame:
    """Of ``trial, step, cell, pref, in_patch, yaw, patch_yaw``: ``level`` over a baseline with the natural total kept.

    Each cell's drive is the rectified match of its preferred direction with the rotation; patch cells follow
    ``patch_yaw``, capped by the whole target; the surround is scaled to bring the total back.
    """
    w = W.partitionBy("trial", "step")
    gain = 1 - baseline
    natural = gain * F.greatest(F.lit(0.0), F.col("pref") * F.col("yaw"))
    patch = gain * F.greatest(F.lit(0.0), F.col("pref") * F.col("patch_yaw"))
    d = delivered.withColumn("_nat", natural).withColumn("_patch", patch)
    target = F.sum("_nat").over(w)
    got = F.sum(F.when(F.col("in_patch"), F.col("_patch")).otherwise(0.0)).over(w)
    outside = F.sum(F.when(~F.col("in_patch"), F.col("_nat")).otherwise(0.0)).over(w)
    d = d.withColumn("_target", target).withColumn("_got", got).withColumn("_outside", outside)
    cap = F.when((F.col("_got") > F.col("_target")) & (F.col("_got") > 1e-9), F.col("_target") / F.nullif(F.col("_got"), F.lit(0.0))).otherwise(1.0)
    scale = F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("_target") - F.col("_got") * cap, "_outside"), F.lit(0.0)))
    above = F.when(F.col("_outside") < 1e-6, 0.0).when(F.col("in_patch"), F.col("_patch") * cap).otherwise(F.col("_nat") * scale)
    return d.withColumn("level", baseline + above).drop("_nat", "_patch", "_target", "_got", "_outside")
