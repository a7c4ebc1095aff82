import math
import random

import pytest
from pyspark.sql import functions as F

from axonframe.plans.all import QUERIES
from axonframe.streaming import live as V

SF = "/root/testdata/sf0.001"


def test_stream_gives_the_closed_blocks_of_the_batch(spark):
    key = lambda r: (r.start, r.kind)
    batch = {key(r): r for r in QUERIES["tumbling_blocks"](spark, SF).collect()}
    stream = {key(r): r for r in QUERIES["stream_blocks"](spark, SF).collect()}
    last = max(k[0] for k in batch)
    assert stream.items() <= batch.items()
    assert {k for k in batch if k[0] < last} <= set(stream)


def test_stream_state_is_the_batch_level(spark):
    ema = {r.key: r.level for r in QUERIES["ema_readout"](spark, SF).collect()}
    rows = QUERIES["stream_agents"](spark, SF).collect()
    most = {}
    for r in rows:
        most[r.key] = max(most.get(r.key, (0, 0.0)), (r.n, r.level))
    assert {k: pytest.approx(v[1], abs=1e-6) for k, v in most.items()} == ema


@pytest.mark.parametrize("k", [0.001, 0.3, 1.0])
def test_leaky_level_over_many_chunks(spark, k):
    v = [float((j * 37) % 11) for j in range(700)]
    df = spark.createDataFrame([("a", j, x) for j, x in enumerate(v)], "g string, i long, x double")
    got = {r.i: r.level for r in V.leaky(df, ["g"], ["i"], "x", k, chunk=50).collect()} if k < 1 else {}
    level = 0.0
    for j, x in enumerate(v):
        level += k * (x - level)
        if got:
            assert got[j] == pytest.approx(level, abs=1e-9)


def test_patches_fade_and_go(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 50.0, 2.0), (3, 200.0, 2.0)], "id long, born double, strength double")
    assert {r.id: r.strength for r in V.alive(df, F.lit(95.0), 90.0).collect()} == {2: pytest.approx(1.0)}


def test_turn(spark):
    df = spark.createDataFrame([(0.4, 0.0, 0.5), (0.9, 0.0, 0.9), (0.1, -0.7, 1.0)], "turn double, flee double, taxis double")
    assert [r[0] for r in df.select(V.heading_command(F.col("turn"), F.col("flee"), F.col("taxis"))).collect()] == pytest.approx([0.65, 1.0, -0.7])


def test_agent_motion_with_and_without_a_brain(spark):
    rows = [(1.0, 2.0, 3.5, -4.0, 0.5, 0.0, 0.0, 10.0), (1.0, 0.5, 1.0, -4.0, 0.0, 0.0, 0.0, 10.0), (None, None, 2.0, 0.0, 0.1, 0.5, -1.0, 10.0)]
    df = spark.createDataFrame(rows, "turn double, forward double, taxis double, flee double, alarm double, smell double, wander double, speed double")
    got = V.agent_motion(df).select("turn_rate", "new_speed").collect()
    assert [r.turn_rate for r in got] == pytest.approx([1.7, 3.2, 1.3])
    assert [r.new_speed for r in got] == pytest.approx([60.0, 10 + 0.15 * 35, 10 + 0.15 * 57])


def test_narrative_has_no_rounding_at_thresholds(spark, tmp_path):
    """A mean of just 45 is busy, and equal sums of as many values go to the first kind, in whatever order they are added."""
    from axonframe.plans.live_queries import narrative

    views = [30.1, 59.9, 45.07, 44.93, 45.1, 44.9, 0.1, 89.9, 70.7, 19.3]
    others = [("click", v) for v in (58.4, 58.56, 0.1, 116.86, 58.48, 58.47, 58.49)] + [("purchase", v) for v in (58.41, 58.55, 0.3, 116.66, 58.48, 58.46, 58.5)]
    rows = []
    for user in range(60):
        rng = random.Random(user)
        of = [("view", v) for v in views] + others
        rng.shuffle(of)
        rows += [(user, k, v) for k, v in of]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.lead, r.mood) for r in narrative(spark, str(tmp_path)).collect()} == {("click", "busy")}


def test_exact_mean_takes_any_double(spark):
    from axonframe.functions.exprs import exact_mean

    inf, nan = float("inf"), float("nan")
    rows = [("a", 0.1), ("a", 0.2), ("a", None), ("b", 1e300), ("b", 1e300), ("c", inf), ("c", 1.0), ("d", None), ("e", nan), ("e", 1.0), ("f", 1 / 3), ("f", 1e-12), ("g", 9e11), ("g", 9e11), ("h", -0.07), ("h", 0.07)]
    got = {r.g: r.m for r in spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(exact_mean("v").alias("m")).collect()}
    assert got.pop("e") != 0 and math.isnan(spark.createDataFrame([(nan,)], "v double").agg(exact_mean("v")).first()[0])
    assert got == {"a": 0.15, "b": 1e300, "c": inf, "d": None, "f": (1 / 3 + 1e-12) / 2, "g": 9e11, "h": 0.0}
