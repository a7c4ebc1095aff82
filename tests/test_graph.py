import random

import pytest
from pyspark.sql import functions as F

from axonframe.functions.exprs import prefix_sums
from axonframe.operators import graph as G


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.randrange(40), rng.randrange(40), round(rng.gauss(0, 3), 2)) for _ in range(300)], "pre long, post long, w double")


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


def test_growth_stops_at_the_budget(spark, edges):
    got = G.grow(edges, ids(spark, [1, 2]), 12, 5, per_round=4).collect()
    assert len(got) == 12 and {r.id for r in got if r["round"] == 0} == {1, 2}
    assert sorted(r.idx for r in G.reindexed(G.grow(edges, ids(spark, [1, 2]), 12, 5)).collect()) == list(range(12))


def test_hops_by_search(spark, edges):
    links = {}
    for r in edges.collect():
        links.setdefault(r.pre, set()).add(r.post)
    want, front = {3: 0}, {3}
    for k in range(1, 7):
        front = {y for x in front for y in links.get(x, ())} - set(want)
        want |= {y: k for y in front}
    assert {r.id: r.hop for r in G.hops(edges, ids(spark, [3])).collect()} == want


def test_degrees_add_up(edges):
    rows = sorted(G.csr_offsets(edges).collect(), key=lambda r: r.id)
    assert sum(r.degree for r in rows) == 300
    at = 0
    for r in rows:
        assert r.row_start == at
        at += r.degree


def test_decimation_keeps_at_least_one_of_each_sender(edges):
    cut = G.decimated(edges, 50, [F.desc(F.abs("w")), F.asc("post")])
    assert {r.pre for r in cut.select("pre").collect()} == {r.pre for r in edges.select("pre").collect()}
    assert cut.count() < 300


def test_prefix_sums_with_ties_and_one_value(spark):
    rng = random.Random(1)
    v = [rng.choice([1.5, 2.0, -7.0, 3.25]) for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in v], "k double")
    for r in prefix_sums(df, "k", {"c": F.lit(1)}, buckets=7).collect():
        assert r.c == sum(x <= r.k for x in v)
    assert {r.c for r in prefix_sums(df.filter("k = 2"), "k", {"c": F.lit(1)}).collect()} == {v.count(2.0)}
    assert prefix_sums(df.filter("false"), "k", {"c": F.lit(1)}).count() == 0


def test_near_by_brute_force(spark):
    rng = random.Random(3)
    pts = [(k, rng.random(), rng.random()) for k in range(60)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r.id, r.other) for r in G.near(df, df, 0.15).collect()}
    assert got == {(a, b) for a, x, y in pts for b, p, q in pts if ((x - p) ** 2 + (y - q) ** 2) ** 0.5 <= 0.15}


def test_weighted_sample_reaches_its_target(spark):
    df = spark.createDataFrame([(k, float(k % 5)) for k in range(100)], "id long, weight double")
    got = G.weighted_sample(df, 50.0, "s").collect()
    total = sum(r.weight for r in got)
    assert 50 <= total < 55 and all(r.weight > 0 for r in got)
    assert {r.id for r in got} == {r.id for r in G.weighted_sample(df.repartition(3), 50.0, "s").collect()}


def test_split_of_two_clusters(spark):
    df = spark.createDataFrame([(float(k % 3),) for k in range(30)] + [(100.0 + k % 3,) for k in range(30)], "x double")
    r = G.best_split(df, "x").first()
    assert r.cut == 2.0 and r.explained > 0.99
    assert G.best_split(df.filter("x = 1"), "x").count() == 0


def test_silence_and_sign(spark, edges):
    assert all(r.w == 0 for r in G.silenced(edges, ids(spark, [5, 6])).filter("pre in (5, 6)").collect())
    both = G.signed(edges.withColumn("w", F.abs("w")), ids(spark, [5]), 2.0)
    assert all((r.w <= 0) == (r.pre == 5 or r.w == 0) for r in both.collect())


def test_pair_queries_take_all_points(spark):
    from axonframe.plans.all import QUERIES
    from axonframe.plans.fixtures import coords

    p = [tuple(r) for r in coords(spark, "/root/testdata/sf0.01").select("id", "x", "y").collect()]
    d = {(a, b): ((x - u) ** 2 + (y - v) ** 2) ** 0.5 for a, x, y in p for b, u, v in p if a != b}
    got = QUERIES["proximity_join"](spark, "/root/testdata/sf0.01").collect()
    assert {(r.id, r.other) for r in got} == {k for k, v in d.items() if v <= 0.02} and any(r.other % 3 for r in got)
    seen = QUERIES["sight_rays"](spark, "/root/testdata/sf0.01").collect()
    assert {r.id % 5 for r in seen} == set(range(5))
    assert 0 < sum(r.seen for r in seen) <= sum(v <= 0.05 for v in d.values())


def test_top_pathways_go_beyond_eight(spark):
    from axonframe.plans.all import QUERIES

    every = QUERIES["population_matrix"](spark, "/root/testdata/sf0.001").count()
    assert QUERIES["top_pathways"](spark, "/root/testdata/sf0.001").count() == min(24, every) > 8


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_prefix_sums_of_keys_that_lie_unevenly(spark, kind):
    from axonframe.functions.exprs import prefix_sums

    rng = random.Random(2)
    rows = [(int(rng.expovariate(1) ** 6) if kind == "bigint" else rng.expovariate(1) ** 6, rng.randint(-3, 9)) for _ in range(700)] + [(5, 1)] * 30 + [(10**9, 2)]
    df = spark.createDataFrame([(float(k) if kind == "double" else k, v) for k, v in rows], f"k {kind}, v long")
    got = sorted((r.k, r.v, r.s) for r in prefix_sums(df, "k", {"s": F.col("v")}, 16).collect())
    assert got == sorted((k, v, sum(y for x, y in rows if x <= k)) for k, v in rows)
    assert prefix_sums(df.filter("false"), "k", {"s": F.col("v")}).count() == 0
