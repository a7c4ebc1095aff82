"""Experiments on a circuit: sweeps, doses, scenarios and runs, over tables of spikes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators import readout as R
from axonframe.operators.simulate import Circuit, CircuitTable, circuit_of, input_conductances, population_rates, run_trials, spikes_only
from axonframe.sources.tables import stored

#: Fixed values of the scenarios: levels of smell, taste, danger, motion in view and the own body in view.
SCENARIOS = {"rest": (0.0, 0.0, 0.0, 0.0, 0.0), "smell at rest": (0.5, 0.0, 0.0, 0.0, 0.08), "smell in flight": (0.6, 0.0, 0.0, 0.5, 0.08), "feeding": (0.6, 0.8, 0.0, 0.15, 0.08), "escape": (0.2, 0.0, 0.9, 0.8, 0.08)}
#: What of motion and body reaches the view's pool, its share of the largest rate, and the resting events a second of every cell.
VIEW_MOTION, VIEW_SELF, VIEW_SHARE, RESTING_HZ = 0.75, 0.5, 0.6, 6.0


def planned(spark: SparkSession, rows: list[tuple[str, float, float, float, float]], trials: int) -> DataFrame:
    """A plan for :func:`axonframe.operators.simulate.run_trials`: each row (arm, drive, patch, kappa, gain) ``trials`` times."""
    return spark.createDataFrame([(a, t, *x) for a, *x in rows for t in range(trials)], "arm string, trial long, drive double, patch double, kappa double, gain double")


def opened(tables: dict[str, DataFrame]) -> tuple[Circuit, DataFrame, DataFrame, dict[str, np.ndarray]]:
    """Of a stored circuit (:func:`axonframe.sources.circuit.read_blob`): the circuit, its edges, ``neuron, population`` and the groups' cells by name."""
    edges = tables["edges"].select("pre", "post", F.col("w").cast("double").alias("w"))
    of = tables["neurons"].select(F.col("index").alias("neuron"), F.col("population").cast("long").alias("population"))
    groups: dict[str, list[int]] = {}
    for r in tables["groups"].collect():  # named pools of a reduced graph
        groups.setdefault(r["name"], []).append(r["index"])
    return circuit_of(edges, of.count()), edges, of, {g: np.array(sorted(v)) for g, v in groups.items()}


def run_exp(tables: dict[str, DataFrame], name: str, excite: list[int], excite2: list[int] = (), silence: list[int] = (), hz: float = 150.0, hz2: float = 0.0, seconds: float = 1.0, trials: int = 30) -> DataFrame:
    """``exp_name, trial, id, t`` (s): spikes while the cells with ids in ``excite`` get events at ``hz`` and those in ``excite2`` at ``hz2``; what the cells in ``silence`` send counts nothing."""
    spark = tables["neurons"].sparkSession
    names = tables["neurons"].select(F.col("index").alias("neuron"), "id")
    numbers = {r.id: r.neuron for r in names.filter(F.col("id").isin([*excite, *excite2, *silence])).collect()}
    missing = {*excite, *excite2, *silence} - set(numbers)
    if missing:
        raise ValueError(f"no such cells: {sorted(missing)[:5]}")
    cells = lambda ids: np.array(sorted(numbers[i] for i in ids), dtype=np.int64)
    off = spark.createDataFrame([(numbers[i],) for i in silence], "pre long")
    edges = tables["edges"].select("pre", "post", F.col("w").cast("double").alias("w")).join(F.broadcast(off), "pre", "left_anti")
    plan = planned(spark, [(name, 1.0, 0.0, 1.0, 0.0)], trials)
    spikes = run_trials(plan, circuit_of(edges, names.count()), cells(excite), seconds, max_hz=hz, second=cells(excite2), second_hz=hz2, always_ready=True)
    return spikes_only(spikes).join(names, "neuron").select(F.col("arm").alias("exp_name"), "trial", "id", (F.col("t") / 1000).alias("t"))


def gain_sweep(c: Circuit | CircuitTable, edges: DataFrame, of: DataFrame, pool: np.ndarray, kappas: list[float], seconds: float, drive: float = 0.6) -> DataFrame:
    """``arm, population, cells, active, rate_hz, exc, inh`` by scale of the weights (arm ``k...``): rates, and the mean conductances that cells receive."""
    spark, arms = of.sparkSession, {f"k{k}": float(k) for k in kappas}
    s = stored(spikes_only(run_trials(planned(spark, [(a, drive, 0.0, k, 0.0) for a, k in arms.items()], 1), c, pool, seconds)), "spikes")
    scales = spark.createDataFrame(list(arms.items()), "arm string, kappa double")
    into = input_conductances(s, edges, of, ["arm"], seconds).join(F.broadcast(scales), "arm")
    into = into.select("arm", "population", (F.col("exc") * F.col("kappa")).alias("exc"), (F.col("inh") * F.col("kappa")).alias("inh"))
    silent = scales.select("arm", F.lit(-1).cast("long").alias("neuron"))  # so that an arm without a spike is listed
    rates = population_rates(s.select("arm", "neuron").unionByName(silent), of, ["arm"], seconds)
    return rates.join(into, ["arm", "population"], "left").fillna(0.0, ["exc", "inh"])


def scenarios(c: Circuit | CircuitTable, of: DataFrame, pools: dict[str, np.ndarray], seconds: float = 1.0) -> DataFrame:
    """``scenario, population, cells, active, rate_hz`` in the second half of each scenario; ``pools``: the cells for smell, taste, danger and view."""
    levels = [(name, smell, taste, danger, VIEW_SHARE * min(1.0, VIEW_MOTION * motion + VIEW_SELF * own)) for name, (smell, taste, danger, motion, own) in SCENARIOS.items()]
    plan = of.sparkSession.createDataFrame([(a, 0, 0.0, 0.0, 1.0, 0.0, *x) for a, *x in levels], "arm string, trial long, drive double, patch double, kappa double, gain double, smell double, taste double, danger double, view double")
    s = stored(spikes_only(run_trials(plan, c, np.arange(1), seconds, pools=pools, resting=RESTING_HZ, resting_events=1.0)).filter(F.col("t") >= seconds * 500), "spikes")
    silent = plan.select("arm").withColumn("neuron", F.lit(-1).cast("long"))
    return population_rates(s.select("arm", "neuron").unionByName(silent), of, ["arm"], seconds / 2).withColumnRenamed("arm", "scenario")


def dose(spark: SparkSession, c: Circuit | CircuitTable, pool: np.ndarray, shares: list[float], trials: int, seconds: float, drive: float = 0.6, width: float = 50.0) -> DataFrame:
    """``frac, trial`` and the dose metrics: rates of all, the pool and four families, active share, deviation over bins, time constant, bump, dimension and injected events."""
    n, count, by = c.n, round(seconds * 1000 / width), ["arm", "trial"]
    plan = planned(spark, [(str(f), drive, f, 1.0, 0.0) for f in shares], trials)
    events = stored(run_trials(plan, c, pool, seconds, resting=2.0), "spikes")
    s = spikes_only(events)
    family = lambda k: (F.count_if(F.col("neuron") % 4 == k) / F.lit(max(1, len(range(k, n, 4))) * seconds)).alias(f"family{k}_hz")
    in_pool = F.broadcast(spark.createDataFrame([(int(x), True) for x in pool], "neuron long, in_pool boolean"))
    base = s.join(in_pool, "neuron", "left").groupBy(*by).agg((F.count(F.lit(1)) / F.lit(n * seconds)).alias("rate_hz"), (F.countDistinct("neuron") / F.lit(float(n))).alias("active"), (F.count("in_pool") / F.lit(len(pool) * seconds)).alias("pool_hz"), *[family(k) for k in range(4)])
    b = R.binned(s, [*by, "neuron"], width, 0.0, seconds * 1000)
    sd = R.population_deviation(b, by, n, count, width / 1000).select(*by, F.col("sd_rate").alias("rate_sd_hz"))
    tau = R.autocorrelation_time(R.dense_series(b, by, count), by, width, count // 2 - 1).withColumnRenamed("tau", "tau_ms")
    bump = R.population_vector(b, [*by, "bin"], (F.col("neuron") % 16) * (2 * math.pi / 16)).groupBy(*by).agg(F.avg("amplitude").alias("bump"))
    spine = plan.select(*by).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    states = b.groupBy(*by, "bin").agg(*[F.sum(F.when(F.col("neuron") % 16 == k, F.col("n")).otherwise(0)).alias(f"s{k}") for k in range(16)])
    states = spine.join(states, [*by, "bin"], "left").fillna(0).select(*by, F.array(*[F.col(f"s{k}").cast("double") for k in range(16)]).alias("state"))
    dim = R.vector_participation_ratio(states, by, "state").withColumnRenamed("ratio", "dim")
    injected = events.filter("neuron < 0").groupBy(*by).agg(F.count(F.lit(1)).alias("injected"))
    out = plan.select(*by, F.col("patch").alias("frac"))
    for part in (base, sd, tau, bump, dim, injected):
        out = out.join(part, by, "left")
    return out.drop("arm").fillna(0, ["rate_hz", "active", "pool_hz", "rate_sd_hz", "injected", *[f"family{k}_hz" for k in range(4)]])


def steady_direction(spark: SparkSession, c: Circuit | CircuitTable, of: DataFrame, pool: np.ndarray, seconds: float) -> DataFrame:
    """Two runs of steady rotation, right and left, of a pool whose cells prefer either in turn: how selective populations are for the side."""
    plan = planned(spark, [("right", 0.0, 0.0, 1.0, 0.0), ("left", 0.0, 0.0, 1.0, 0.0)], 1).withColumn("yaw", F.when(F.col("arm") == "right", 1.0).otherwise(-1.0))
    runs = spikes_only(run_trials(plan, c, pool, seconds, preferred=np.where(np.arange(len(pool)) % 2, -1.0, 1.0)))
    s = runs.groupBy("neuron").agg((F.count_if(F.col("arm") == "right") / seconds).alias("r"), (F.count_if(F.col("arm") == "left") / seconds).alias("l"))
    every = of.join(s, "neuron", "left").fillna(0.0, ["r", "l"])
    return R.direction_index(every.withColumn("w", (F.col("neuron") % 5 - 2).cast("double")), ["population"])
