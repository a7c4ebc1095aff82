import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import readout as R
from axonframe.operators import stimulus as S
from axonframe.operators.simulate import Circuit, CircuitTable, Loop, Membrane, Network, circuit_of, packed, run_trials


def random_circuit(n=30, m=300, seed=0):
    rng = np.random.default_rng(seed)
    pre = np.sort(rng.integers(0, n, m))
    return Circuit(np.concatenate([[0], np.cumsum(np.bincount(pre, minlength=n))]), rng.integers(0, n, m), rng.normal(5, 20, m).astype(np.float32))


def plain(circuit, stimulus, m):
    """The model cell by cell, edge by edge."""
    n, f = circuit.n, np.float32
    v, g, wait = [f(m.rest)] * n, [f(0)] * n, [f(0)] * n
    due = [[f(0)] * n for _ in range(round(m.delay / m.dt))]
    decay, out = f(np.exp(-m.dt / m.tau_synapse)), []
    for s, cells in enumerate(stimulus):
        for c in cells:
            g[c] += f(m.w_syn * m.stimulus_factor)
        slot = due[s % len(due)]
        for i in range(n):
            g[i] += slot[i]
            slot[i] = f(0)
        fired = []
        for i in range(n):
            if wait[i] > 0:
                wait[i] -= f(m.dt)
                continue
            x = v[i] + f(m.dt / m.tau_membrane) * (f(m.rest) - v[i] + g[i])
            if x > m.threshold:
                v[i], g[i], wait[i] = f(m.reset), f(0), f(m.refractory)
                fired.append(i)
            else:
                v[i], g[i] = max(x, f(m.floor)), g[i] * decay
        for i in fired:
            for e in range(circuit.offsets[i], circuit.offsets[i + 1]):
                slot[circuit.targets[e]] += circuit.weights[e]
        out.append(fired)
    return out


def test_kernel_against_plain_loop():
    c, m, rng = random_circuit(), Membrane(), np.random.default_rng(1)
    stimulus = [np.flatnonzero(rng.random(c.n) < 0.02) for _ in range(200)]
    net, got = Network(c, m), []
    for cells in stimulus:
        net.inject(cells, m.w_syn * m.stimulus_factor)
        got.append(net.step().tolist())
    want = plain(c, stimulus, m)
    assert got == want
    assert sum(map(len, want)) > 50


def test_trials_share_draws_and_rerun_alike(spark):
    c = random_circuit()
    plan = spark.createDataFrame([(a, t, 0.8, p, 1.0, 0.0) for a, p in (("x", 0.0), ("y", 0.0), ("z", 1.0)) for t in (0, 1)], "arm string, trial long, drive double, patch double, kappa double, gain double")
    rows = run_trials(plan, c, np.arange(10), 0.2).collect()
    of = lambda a: sorted((r.trial, r.neuron, r.t) for r in rows if r.arm == a and r.neuron >= 0)
    assert of("x") == of("y") and of("x") and not of("z")
    assert sorted(rows) == sorted(run_trials(plan.repartition(5), c, np.arange(10), 0.2).collect())


def test_too_large_a_circuit_is_refused(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0)], "pre long, post long, w double")
    assert circuit_of(edges, 2).weights.tolist() == [1.0, 2.0]
    with pytest.raises(ValueError, match="too many"):
        circuit_of(edges, 2, most_edges=1)


def test_loop_turns_against_a_change():
    loop = Loop(1.0)
    assert loop.update(0.0, 0.01) == 0
    assert loop.update(5.0, 0.01) > 0


def cells(spark):
    s = S.signal(S.steps(spark, 2, 60), 0.0005, "t").withColumnRenamed("x", "flow")
    c = s.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("patch_flow", (F.col("step") % 60).cast("double"))
    return c.withColumns({"in_patch": F.col("cell") < 3, "pref": F.sin("cell"), "yaw": 2 * F.col("flow") - 1, "patch_yaw": F.col("flow") - 0.5})


def test_drive_is_balanced_each_step(spark):
    for r in S.flow_levels(cells(spark)).groupBy("trial", "step").agg(F.sum("level").alias("s"), (F.count(F.lit(1)) * F.first("flow")).alias("want")).collect():
        assert r.s == pytest.approx(r.want)
    natural = 0.12 + 0.88 * F.greatest(F.lit(0.0), F.col("pref") * F.col("yaw"))
    for r in S.yaw_levels(cells(spark)).withColumn("nat", natural).groupBy("trial", "step").agg(F.sum("level").alias("s"), F.sum("nat").alias("want")).collect():
        assert r.s == pytest.approx(r.want)


def test_block_shuffle_permutes(spark):
    s = S.block_shuffled(S.signal(S.steps(spark, 1, 65), 0.0005, "t"), 20, "b").collect()
    assert len(s) == 65
    assert sorted(r.x for r in s) == sorted(r.shuffled for r in s)
    assert all(r.x == r.shuffled for r in s if r.step >= 60)


def test_participation_ratio_is_within_its_bounds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * [3, 2, 1, 0.1]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, a double, b double, c double, d double")
    got = R.participation_ratio(df, ["g"], [F.col(c) for c in "abcd"]).first().ratio
    ev = np.linalg.eigvalsh(np.cov(x.T))
    assert got == pytest.approx(ev.sum() ** 2 / (ev**2).sum()) and 1 <= got <= 4


def test_autocorrelation_variants(spark):
    x = np.sin(np.arange(60) / 3) + np.random.default_rng(0).normal(size=60) * 0.1
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(x)], "g string, bin long, x double")
    d = x - x.mean()
    acf = [float((d[: 60 - k] * d[k:]).sum() / (d * d).sum()) for k in range(11)]
    assert R.autocorrelation_time(df, ["g"], 2.0, 10).first().tau == pytest.approx(2 * sum(max(0, a) for a in acf))
    low = next(k for k in range(1, 11) if acf[k] < 0.05)
    assert R.autocorrelation_time(df, ["g"], 2.0, 10, include_zero=False, cutoff=0.05).first().tau == pytest.approx(2 * sum(max(0, a) for a in acf[1:low]))
    assert R.autocorrelation_time(df.withColumn("x", F.lit(1.0)), ["g"], 2.0, 10).first().tau is None


def test_participation_ratio_takes_whole_vectors(spark):
    x = np.random.default_rng(4).normal(size=(300, 12)) + 50
    rows = [(None if k % 3 == 2 else k % 3, v.tolist()) for k, v in enumerate(x)] + [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (0, None), (0, [1.0] * 11 + [None])]
    df = spark.createDataFrame(rows, "g long, v array<double>").repartition(5)
    got = {r.g: r.ratio for r in R.vector_participation_ratio(df, ["g"], "v").collect()}
    for g, k in ((0, 0), (1, 1), (None, 2)):
        ev = np.linalg.eigvalsh(np.cov(x[k::3].T))
        assert got[g] == pytest.approx(ev.sum() ** 2 / (ev**2).sum()) and got[g] > 8
    assert got[7] is None
    with pytest.raises(Exception, match="components in one group"):
        R.vector_participation_ratio(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "g long, v array<double>"), ["g"], "v").collect()


def test_circuit_has_a_neuron_a_user(spark):
    from axonframe.plans.fixtures import event_graph
    from axonframe.plans.readout_queries import _circuit

    for sf in ("0.001", "0.01"):
        g = event_graph(spark, f"/root/testdata/sf{sf}").select("pre", "post").distinct().collect()
        c, e, n = _circuit(spark, f"/root/testdata/sf{sf}")
        assert n == c.n == len({u for r in g for u in r})
        assert e.count() == len(c.targets) == len(g)


def test_sizes_of_the_readouts(spark):
    from axonframe.plans import readout_queries as Q

    for n, want in ((1, 0), (15, 105), (25, 300), (26, 300), (1500, 300)):
        got = [(r.a, r.b) for r in R.distinct_pairs(spark.range(n).withColumnRenamed("id", "neuron"), 300, "s").collect()]
        assert len(got) == len(set(got)) == want and all(a < b for a, b in got)
    assert Q.LAGS == 15
    x = spark.createDataFrame([("g", k, float(k in (0, 12))) for k in range(30)], "arm string, bin long, x double")  # alike at lag 12
    assert R.autocorrelation_time(x, ["arm"], 0.5, Q.LAGS - 1).first().tau > R.autocorrelation_time(x, ["arm"], 0.5, 10).first().tau


def test_all_arms(spark):
    got = {r.arm: (r.patch, r.alpha, r.drive, r.synch) for r in S.all_arms(spark).collect()}
    assert len(got) == 12
    assert (got["self"], got["flow"], got["shuffle"]) == (("body", 0, 1, False), ("none", 0, 1, False), ("random", 0, 1, False))
    assert (got["conf25"][1], got["drive1.5"][2], got["synch"][3]) == (0.25, 1.5, True)


def test_second_pool_has_its_own_rate(spark):
    plan = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.0)], "arm string, trial long, drive double, patch double, kappa double, gain double")
    c = Circuit(np.zeros(11, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    fired = {hz: run_trials(plan, c, np.arange(5), 1.0, second=np.arange(5, 10), second_hz=hz).toPandas() for hz in (0.0, 40.0, 120.0)}
    assert len(fired[0.0]) == 0 and 0 < len(fired[40.0]) < len(fired[120.0])
    assert set(fired[120.0].neuron) == set(range(5, 10))


PLAN = "arm string, trial long, drive double, patch double, kappa double, gain double"
SILENT = Circuit(np.zeros(11, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))


def test_pools_by_name_fire_at_their_own_rates(spark):
    plan = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.0, 0.2, 0.9), ("b", 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.9)], PLAN + ", smell double, taste double")
    rows = run_trials(plan, SILENT, np.arange(1), 2.0, pools={"smell": np.arange(2, 5), "taste": np.arange(6, 9)}).toPandas()
    n = lambda arm, cells: int(((rows.arm == arm) & rows.neuron.isin(cells)).sum())
    assert set(rows.neuron) == {2, 3, 4, 6, 7, 8}
    assert 0 < n("a", [2, 3, 4]) < n("a", [6, 7, 8]) and n("b", [2, 3, 4]) == 0
    assert n("a", [6, 7, 8]) == n("b", [6, 7, 8])  # a stream of its own


def test_targets_without_refractory_time(spark):
    plan = spark.createDataFrame([("a", 0, 1.0, 0.0, 1.0, 0.0)], PLAN)
    runs = {ready: run_trials(plan, SILENT, np.arange(5), 2.0, max_hz=600.0, always_ready=ready).toPandas() for ready in (False, True)}
    steps = {ready: np.concatenate([np.diff(np.sort(g.t)) for _, g in p[p.neuron >= 0].groupby("neuron")]) for ready, p in runs.items()}
    assert steps[False].min() >= Membrane().refractory and steps[True].min() < Membrane().refractory
    injected = runs[True][runs[True].neuron < 0]
    assert abs(len(injected) - 5 * 600 * 2) < 5 * np.sqrt(5 * 600 * 2) and set(-1 - injected.neuron) == set(range(5))


def test_rotation_drives_cells_by_their_preference(spark):
    plan = spark.createDataFrame([("right", 0, 0.0, 0.0, 1.0, 0.0, 1.0), ("left", 0, 0.0, 0.0, 1.0, 0.0, -1.0)], PLAN + ", yaw double")
    p = run_trials(plan, SILENT, np.arange(10), 3.0, preferred=np.where(np.arange(10) < 5, 1.0, -1.0)).toPandas()
    hit = lambda arm, first: int(((p.arm == arm) & (p.neuron < 0) & ((-1 - p.neuron < 5) == first)).sum())
    for arm, first in (("right", True), ("left", False)):
        assert hit(arm, first) == pytest.approx(5 * 150 * 3, rel=0.08)
        assert hit(arm, not first) == pytest.approx(5 * 150 * 3 * 0.12, rel=0.25)


def test_rates_and_conductances_by_population(spark):
    from axonframe.operators.simulate import input_conductances, population_rates

    of = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "neuron long, population long")
    spikes = spark.createDataFrame([("x", 0)] * 4 + [("x", 2)] * 2 + [("y", 3)] * 6, "arm string, neuron long")
    got = {(r.arm, r.population): (r.cells, r.active, r.rate_hz) for r in population_rates(spikes, of, ["arm"], 2.0).collect()}
    assert got == {("x", 0): (2, 0.5, 1.0), ("x", 1): (2, 0.5, 0.5), ("x", 2): (1, 0.0, 0.0), ("y", 0): (2, 0.0, 0.0), ("y", 1): (2, 0.5, 1.5), ("y", 2): (1, 0.0, 0.0)}
    edges = spark.createDataFrame([(0, 2, 5.0), (0, 3, 1.0), (2, 3, -4.0), (3, 4, 2.0)], "pre long, post long, w double")
    got = {(r.arm, r.population): (round(r.exc, 9), round(r.inh, 9)) for r in input_conductances(spikes, edges, of, ["arm"], 2.0).collect()}
    assert got == {("x", 1): (2.0 * 6 * 0.005 / 2, -1.0 * 4 * 0.005 / 2), ("y", 2): (3.0 * 2 * 0.005, 0.0)}


def test_ring_trajectory_against_singular_values(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(3.0, (30, 12)).astype(float) + 4 * np.add.outer(np.sin(np.arange(30) / 3), np.cos(np.arange(12)))**2 // 1
    rows = [("g", b, c, float(x[b, c])) for b in range(30) for c in range(12)]
    got = R.ring_trajectory(spark.createDataFrame(rows, "arm string, bin long, cell long, n double"), ["arm"], 12, 30).first()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    angle = np.unwrap(np.arctan2(u[:, 1] * s[1], u[:, 0] * s[0]))
    assert got.share == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    assert got.loop == pytest.approx(np.abs(np.diff(angle)).sum() / (2 * np.pi) / 30)


def test_simulation_queries_hold_their_laws(spark):
    from axonframe.operators.experiments import SCENARIOS
    from axonframe.plans import readout_queries as Q

    sf = "/root/testdata/sf0.001"
    s = Q.scenario_preview(spark, sf).toPandas()
    assert len(s) == 5 * Q.POPULATIONS and set(s.scenario) == set(SCENARIOS)
    rate = s.set_index(["scenario", "population"]).rate_hz
    for name, (smell, taste, danger, *_) in SCENARIOS.items():  # a driven pool fires more than at rest
        for k, level in enumerate((smell, taste, danger)):
            assert not level or rate[name, k] > rate["rest", k] + 5
    d = Q.dose_trials(spark, sf).toPandas().set_index(["frac", "trial"]).sort_index()
    assert len(d) == 8 and (d.loc[1.0].injected == 0).all() and (d.loc[0.0].injected > d.loc[0.5].injected).all()
    assert (d.loc[0.0].pool_hz > d.loc[1.0].pool_hz).all() and (d.dim.dropna() >= 1).all()
    g = Q.gain_sweep(spark, sf).toPandas()
    assert len(g) == 3 * Q.POPULATIONS and (g.exc >= 0).all() and (g.inh <= 0).all() and (g.rate_hz > 0).any()
    z = Q.steady_direction(spark, sf).toPandas()
    assert sorted(z.population) == list(range(Q.POPULATIONS)) and z.selectivity.dropna().between(-1, 1).all()


def test_bump_in_the_plane_of_places(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3)) @ np.diag([3.0, 2.0, 0.1]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 10
    n = rng.poisson(2.0, (6, 40))
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "neuron long, x double, y double, z double")
    bins = spark.createDataFrame([("g", b, k, int(n[b, k])) for b in range(6) for k in range(40) if n[b, k]], "arm string, bin long, neuron long, n long")
    u = np.linalg.svd(x - x.mean(axis=0))[2][:2]
    angle = np.arctan2((x - x.mean(axis=0)) @ u[1], (x - x.mean(axis=0)) @ u[0])
    want = np.mean([abs((n[b] * np.exp(1j * angle)).sum()) / n[b].sum() for b in range(6)])
    got = R.bump(bins, R.plane_angles(points), ["arm"]).first()
    assert got.bins == 6 and got.amplitude == pytest.approx(want)


def test_uniform_arms_have_no_patch_by_design(spark):
    df = spark.createDataFrame([(a, k < 2, 0.1 if k < 2 and a != "none" else 1.0) for a in ("none", "body") for k in range(6)], "arm string, in_patch boolean, level double")
    got = {r.arm: r.verdict for r in R.manipulation(df, ["arm"], F.col("arm") == "none").collect()}
    assert got == {"none": "natural", "body": "below natural"}


def test_experiments_on_a_stored_circuit(spark, tmp_path, monkeypatch):
    """From a binary file through the command line, and runs by cells' ids."""
    import sys

    from axonframe import __main__ as main
    from axonframe.operators import experiments as X
    from axonframe.sources import circuit as C

    rng = np.random.default_rng(2)
    cells = [(k, 500 + k, 0.0, 0.0, 0.0, k % 3, 0) for k in range(30)]
    edges = [(int(a), int(b), 40.0, False, 40.0) for a, b in zip(rng.integers(0, 10, 120), rng.integers(10, 30, 120), strict=True)]
    groups = [(g, k) for j, g in enumerate(("odor", "sugar", "motor", "self_motion")) for k in range(2 * j, 2 * j + 2)]
    path = str(tmp_path / "c.bin")
    C.write_blob(path, *(spark.createDataFrame(rows, C.SCHEMAS[name]) for rows, name in ((cells, "neurons"), (edges, "edges"), (groups, "groups"))))
    tables = C.read_blob(spark, path)
    fired = lambda **o: {r.id: r.n for r in X.run_exp(tables, "e", [500, 501], seconds=0.5, trials=2, **o).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain, quiet = fired(), fired(silence=[500, 501])
    assert set(quiet) == {500, 501} < set(plain) and quiet[500] == plain[500]
    assert {502} <= set(fired(excite2=[502], hz2=80.0)) - set(quiet)
    with pytest.raises(ValueError, match="no such cells"):
        X.run_exp(tables, "e", [1])
    for command in (["sweep", path, f"{tmp_path}/sweep", "--kappas", "1", "2", "--seconds", "0.2"], ["scenarios", path, f"{tmp_path}/scenes", "--seconds", "0.2"], ["dose", path, f"{tmp_path}/dose", "--fracs", "0", "1", "--trials", "1", "--seconds", "0.2"], ["run", path, f"{tmp_path}/spikes", "--excite", "500", "501", "--seconds", "0.2", "--trials", "2"], ["rates", f"{tmp_path}/spikes", f"{tmp_path}/rates", "--seconds", "0.2", "--trials", "2"]):
        monkeypatch.setattr(sys, "argv", ["axonframe", *command])
        main.main()
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/{name}")
    assert read("sweep").count() == 6 and read("scenes").count() == 15 and read("dose").count() == 2
    assert {int(r.neuron) for r in read("rates").collect()} >= {500, 501}


@pytest.mark.parametrize("name", ["dose_trials", "gain_sweep", "lif_trials", "scenario_preview", "steady_direction"])
def test_no_table_comes_to_the_driver(spark, tmp_path, monkeypatch, name):
    """Of users, edges and spikes the driver gets single rows (counts, quantiles), never the tables."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    from axonframe.plans import readout_queries as Q

    whole = Frame.collect

    def one_row(df):
        got = whole(df)
        assert len(got) <= 1
        return got

    for way in ("toPandas", "toArrow", "toLocalIterator"):
        monkeypatch.setattr(Frame, way, None)
    monkeypatch.setattr(Frame, "collect", one_row)
    getattr(Q, name)(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/out")


def test_a_circuit_in_blocks_runs_like_one_on_the_driver(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 400) // 3 * 3, rng.integers(0, 30, 400), strict=True)} | {(3, k) for k in range(30)})
    w = rng.normal(5, 20, len(pairs)).astype(np.float32)
    plain = Circuit(np.concatenate([[0], np.cumsum(np.bincount([a for a, _ in pairs], minlength=30))]), np.array([b for _, b in pairs]), w)
    edges = spark.createDataFrame([(a, b, float(x)) for (a, b), x in zip(pairs, w, strict=True)], "pre long, post long, w double").repartition(7)
    plan = spark.createDataFrame([(a, t, 0.8, 0.0, k, 0.0) for a, k in (("x", 1.0), ("y", 0.5)) for t in (0, 1)], PLAN)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)  # so that senders are cut between blocks
    try:
        got = CircuitTable(packed(edges), 30)
        c = got.gathered()
        assert c.offsets.tolist() == plain.offsets.tolist() and c.targets.tolist() == plain.targets.tolist() and c.weights.tolist() == w.tolist()
        run = lambda c: sorted(run_trials(plan, c, np.arange(10), 0.2, resting=5.0).collect())
        assert run(got) == run(plain) != []
        none = CircuitTable(packed(edges.filter("false")), 10)
        assert sorted(run_trials(plan, none, np.arange(5), 0.2).collect()) == sorted(run_trials(plan, SILENT, np.arange(5), 0.2).collect()) != []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
