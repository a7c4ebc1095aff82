"""Queries of labels and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators import graph as G
from axonframe.operators import labels as L

from .catalogue import query
from .fixtures import COORDS, EVENT_GRAPH, SPARSE_GRAPH, SUPPLIERS, SUPPLY_GRAPH, coords, event_graph, sparse_graph, suppliers, supply_graph, table

RULES = [("standard", 1), ("promo.*(brass|tin)", 2), ("econ", 3)]
SUB_RULES = [("copper", 1), ("steel", 2)]
SETS = [("brass", "brass"), ("large", "large|jumbo"), ("promo", "^promo")]


def _r(c: str, digits: int = 6) -> F.Column:
    return F.round(c, digits).alias(c)


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_type <> 'error' AND value > 10")
def scan_pruned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null and not isnan(value) and abs(value) < double('infinity') and event_type <> 'error' and value > 10")
    return e.select("event_id", "user_id", _r("value"))


_CLASS = """CASE WHEN regexp_matches(label, 'standard', 'i') THEN 1 WHEN regexp_matches(label, 'promo.*(brass|tin)', 'i') THEN 2
WHEN regexp_matches(label, 'econ', 'i') THEN 3 WHEN p_size > 25 THEN 4 ELSE 0 END"""


@query(f"""WITH a AS (SELECT *, concat_ws(' / ', coalesce(trim(p_type), ''), coalesce(trim(p_name), '')) AS label FROM part), b AS (SELECT *, {_CLASS} AS pop FROM a)
SELECT p_partkey, label, pop::BIGINT AS pop, (CASE WHEN pop <> 1 THEN 0 WHEN regexp_matches(label, 'copper', 'i') THEN 1 WHEN regexp_matches(label, 'steel', 'i') THEN 2 ELSE 9 END)::BIGINT AS family FROM b""")
def label_concat_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("label", L.joined_label(["p_type", "p_name"], " / "))
    p = p.withColumn("pop", L.first_match("label", RULES, F.when(F.col("p_size") > 25, 4).otherwise(0)))
    return p.select("p_partkey", "label", F.col("pop").cast("long").alias("pop"), L.sub_family("pop", 1, "label", SUB_RULES, 9).cast("long").alias("family"))


_SEEDS = """lab AS (SELECT p_partkey AS id, concat_ws(' / ', coalesce(trim(p_type), ''), coalesce(trim(p_name), '')) AS label FROM part),
se AS (SELECT 'brass' AS set, 0 AS rank, id FROM lab WHERE regexp_matches(label, 'brass', 'i') UNION ALL
SELECT 'large', 1, id FROM lab WHERE regexp_matches(label, 'large|jumbo', 'i') UNION ALL SELECT 'promo', 2, id FROM lab WHERE regexp_matches(label, '^promo', 'i'))"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.seed_sets(table(spark, sf_dir, "part").withColumn("label", L.joined_label(["p_type", "p_name"], " / ")), "p_partkey", "label", SETS)


@query(f"""WITH {_SEEDS}, one AS (SELECT id, min(rank) AS rank FROM se GROUP BY id)
SELECT set, count(*) AS members, count(*) FILTER (se.rank = one.rank) AS first_here, min(id) AS lowest FROM se JOIN one USING (id) GROUP BY set""")
def seed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seeds(spark, sf_dir)
    return s.join(L.ordered_seeds(s).withColumnRenamed("rank", "one"), "id").groupBy("set").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("rank") == F.col("one")).alias("first_here"), F.min("id").alias("lowest"))


@query("SELECT count(*) FILTER (regexp_matches(p_type, 'brass', 'i')) AS brass, count(*) FILTER (regexp_matches(p_type, '^small', 'i')) AS small, count(*) FILTER (regexp_matches(p_type, 'x{5}', 'i')) AS nothing FROM part")
def landmark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.landmark_counts(table(spark, sf_dir, "part"), "p_type", {"brass": "brass", "small": "^small", "nothing": "x{5}"})


@query(f"""WITH {SUPPLY_GRAPH}, {SUPPLIERS}, e AS (SELECT sg.*, region, CASE WHEN region IN (0, 1) THEN -w ELSE w END * 0.275 / 1000 AS sw FROM sg LEFT JOIN su ON pre = id)
SELECT coalesce(region, -1)::BIGINT AS region, count(*) AS n, round(sum(sw), 6) AS net, round(sum(abs(sw)), 6) AS gross,
count(*) FILTER (pre % 10 = 0 AND post % 5 = 0) AS plastic, round(sum(CASE WHEN pre % 10 = 0 AND post % 5 = 0 THEN sw * 1.5 ELSE sw END), 6) AS gained FROM e GROUP BY 1""")
def signed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = suppliers(spark, sf_dir), supply_graph(spark, sf_dir)
    w = G.signed(e, s.filter("region in (0, 1)"), 0.275 / 1000)
    w = G.plastic(w, s.filter("id % 10 = 0").select("id"), table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id")).filter("id % 5 = 0"), 1.5)
    w = w.join(s.select(F.col("id").alias("pre"), "region"), "pre", "left")
    return w.groupBy(F.coalesce(F.col("region").cast("long"), F.lit(-1)).alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("base_w"), 6).alias("net"), F.round(F.sum(F.abs("base_w")), 6).alias("gross"), F.count_if("plastic").alias("plastic"), F.round(F.sum("w"), 6).alias("gained")
    )


@query(f"WITH {SUPPLY_GRAPH} SELECT post AS id, count(*) AS n, round(sum(CASE WHEN pre % 3 = 0 THEN 0 ELSE w END), 6) AS left_w FROM sg GROUP BY post")
def silenced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.silenced(supply_graph(spark, sf_dir), suppliers(spark, sf_dir).filter("id % 3 = 0"))
    return e.groupBy(F.col("post").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("left_w"))


_SCORES = "SELECT CASE WHEN a THEN post ELSE pre END AS id, sum(abs(w)) AS score FROM (SELECT *, pre IN (SELECT id FROM {0}) AS a, post IN (SELECT id FROM {0}) AS b FROM eg) WHERE a <> b GROUP BY 1"


@query(f"WITH {EVENT_GRAPH}, s0 AS (SELECT DISTINCT pre AS id FROM eg WHERE pre % 50 = 0) SELECT id, round(score, 6) AS score FROM ({_SCORES.format('s0')})")
def frontier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    return G.frontier_scores(e, e.filter("pre % 50 = 0").select(F.col("pre").alias("id"))).select("id", _r("score"))


@query(f"""WITH {EVENT_GRAPH}, s0 AS (SELECT DISTINCT pre AS id FROM eg WHERE pre % 50 = 0), c1 AS ({_SCORES.format('s0')}), t1 AS (SELECT * FROM c1 ORDER BY score DESC, id LIMIT 5),
s1 AS (SELECT id FROM s0 UNION ALL SELECT id FROM t1), c2 AS ({_SCORES.format('s1')}), t2 AS (SELECT * FROM c2 ORDER BY score DESC, id LIMIT 5),
al AS (SELECT id, 0 AS round, NULL::DOUBLE AS score FROM s0 UNION ALL SELECT id, 1, score FROM t1 UNION ALL SELECT id, 2, score FROM t2)
SELECT id, round::BIGINT AS round, round(score, 6) AS score, row_number() OVER (ORDER BY round, score DESC NULLS LAST, id) - 1 AS idx FROM al""")
def grow_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    g = G.grow(e, e.filter("pre % 50 = 0").select(F.col("pre").alias("id")), 1_000_000, 2, per_round=5)
    return g.join(G.reindexed(g), "id").select("id", F.col("round").cast("long").alias("round"), _r("score"), "idx")


@query(f"WITH {SUPPLY_GRAPH} SELECT pre, post, round(w, 6) AS w FROM sg WHERE pre % 4 = 0 AND post % 7 = 0")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = suppliers(spark, sf_dir).filter("id % 4 = 0").select("id").union(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id")).filter("id % 7 = 0"))
    return G.induced(supply_graph(spark, sf_dir), nodes).select("pre", "post", _r("w"))


@query(f"WITH {SUPPLY_GRAPH}, d AS (SELECT pre AS id, count(*) AS degree FROM sg GROUP BY pre) SELECT id, degree, (sum(degree) OVER (ORDER BY id))::BIGINT - degree AS row_start FROM d")
def csr_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.csr_offsets(supply_graph(spark, sf_dir)).select("id", "degree", F.col("row_start").cast("long").alias("row_start"))


@query("""WITH e AS (SELECT l_suppkey AS pre, l_partkey + 1000000 AS post, l_quantity AS w, l_orderkey AS o, l_linenumber AS l FROM lineitem),
r AS (SELECT *, greatest(1, floor(5000.0::DOUBLE * count(*) OVER (PARTITION BY pre) / count(*) OVER ())) AS share, row_number() OVER (PARTITION BY pre ORDER BY 4 * (post % 3 = 0)::INT + abs(w) DESC, post, o, l) AS nth FROM e)
SELECT pre, count(*) AS kept, round(sum(w), 6) AS w FROM r WHERE nth <= share GROUP BY pre""")
def decimate_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") + 1000000).alias("post"), F.col("l_quantity").alias("w"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"))
    first = F.desc(F.when(F.col("post") % 3 == 0, 4).otherwise(0) + F.abs("w"))
    return G.decimated(e, 5000, [first, F.asc("post"), F.asc("o"), F.asc("l")]).groupBy("pre").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("w"), 6).alias("w"))


@query(f"""WITH RECURSIVE {SPARSE_GRAPH}, h AS (SELECT DISTINCT pre AS id, 0 AS hop FROM eg WHERE pre % 50 = 0 UNION SELECT post, hop + 1 FROM h JOIN sp ON sp.pre = h.id WHERE hop < 6),
m AS (SELECT id, min(hop) AS hop FROM h GROUP BY id) SELECT hop::BIGINT AS hop, count(*) AS nodes, min(id) AS lowest FROM m GROUP BY hop""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = event_graph(spark, sf_dir).filter("pre % 50 = 0").select(F.col("pre").alias("id"))
    return G.hops(sparse_graph(spark, sf_dir), seeds, 6).groupBy(F.col("hop").cast("long").alias("hop")).agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("lowest"))


@query(f"""WITH {EVENT_GRAPH}, i AS (SELECT post AS id, count(*) AS n_in FROM eg WHERE pre % 5 = 0 GROUP BY 1), o AS (SELECT pre AS id, count(*) AS n_out FROM eg WHERE post % 7 = 0 GROUP BY 1)
SELECT id, n_in, n_out, least(n_in, n_out) AS through FROM i JOIN o USING (id) ORDER BY through DESC, id LIMIT 40""")
def two_hop_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    ids = e.select(F.col("pre").alias("id")).union(e.select("post")).distinct()
    return G.two_hop(e, ids.filter("id % 5 = 0"), ids.filter("id % 7 = 0")).withColumn("through", F.least("n_in", "n_out")).orderBy(F.desc("through"), "id").limit(40)


@query(f"""WITH {EVENT_GRAPH}, i AS (SELECT post AS id, count(*) AS from_a FROM eg WHERE pre % 5 = 0 GROUP BY 1 HAVING count(*) >= 3),
o AS (SELECT pre AS id, count(*) FILTER (post % 7 = 0) AS to_ring, count(*) FILTER (post % 11 = 0) AS to_b FROM eg WHERE post % 7 = 0 OR post % 11 = 0 GROUP BY 1)
SELECT id, from_a, to_ring, to_b FROM i JOIN o USING (id) WHERE id % 5 <> 0 AND greatest(to_ring, to_b) >= 3""")
def visual_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    ids = e.select(F.col("pre").alias("id")).union(e.select("post")).distinct()
    return G.relays(e, ids.filter("id % 5 = 0"), ids.filter("id % 7 = 0"), ids.filter("id % 11 = 0")).select("id", "from_a", "to_ring", "to_b")


_POPS = f"""{SUPPLY_GRAPH}, {SUPPLIERS}, pp AS (SELECT p_partkey + 1000000 AS id, 10 + CASE WHEN regexp_matches(p_type, 'standard', 'i') THEN 1 WHEN regexp_matches(p_type, 'promo', 'i') THEN 2 ELSE 0 END AS pop FROM part),
sw AS (SELECT pre, post, CASE WHEN region IN (0, 1) THEN -w ELSE w END AS w, region AS pre_pop, pop AS post_pop FROM sg JOIN su ON pre = su.id JOIN pp ON post = pp.id)"""


def _pops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = suppliers(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id"), (L.first_match("p_type", [("standard", 1), ("promo", 2)], 0) + 10).alias("pop"))
    return G.signed(supply_graph(spark, sf_dir), s.filter("region in (0, 1)")), s.select("id", F.col("region").alias("pop")).union(parts)


@query(f"""WITH {_POPS} SELECT pre_pop::BIGINT AS pre_pop, post_pop::BIGINT AS post_pop, count(*) AS n, count(*) FILTER (w >= 0) AS n_exc, count(*) FILTER (w < 0) AS n_inh, round(sum(abs(w)), 6) AS strength,
CASE WHEN count(*) = 0 THEN 'broken' WHEN count(*) < 50 THEN 'sparse' ELSE 'present' END AS verdict FROM sw GROUP BY 1, 2""")
def population_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.population_matrix(*_pops(spark, sf_dir))
    return m.select(F.col("pre_pop").cast("long").alias("pre_pop"), F.col("post_pop").cast("long").alias("post_pop"), "n", "n_exc", "n_inh", _r("strength"), G.chain_verdict(F.col("n")).alias("verdict"))


#: Links of a chain that should be there: name, sending and receiving populations; no supplier sends to another, and no population 13 exists.
CHAIN = [("home to plain", [0], [10]), ("home to standard", [0], [11]), ("abroad to standard", [1, 2, 3, 4], [11]), ("abroad to promo", [1, 2, 3, 4], [12]), ("within home", [0], [0]), ("to the missing", [0, 1, 2, 3, 4], [13]), ("back", [10, 11, 12], [0, 1, 2, 3, 4])]


@query(f"""WITH {_POPS}, li(link, ord, pre_pops, post_pops) AS (VALUES {', '.join(f"('{n}', {k}::BIGINT, {a}, {b})" for k, (n, a, b) in enumerate(CHAIN))})
SELECT link, ord, n, CASE WHEN n >= 50 THEN 'present' WHEN n > 0 THEN 'sparse' ELSE 'broken' END AS verdict FROM (SELECT link, ord, (SELECT count(*) FROM sw WHERE list_contains(pre_pops, pre_pop) AND list_contains(post_pops, post_pop)) AS n FROM li)""")
def pathway_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named chain link by link; a link without an edge is broken."""
    return G.chain(G.population_matrix(*_pops(spark, sf_dir)), CHAIN)


@query(f"WITH {_POPS} SELECT pre_pop::BIGINT AS pre_pop, post_pop::BIGINT AS post_pop, count(*) AS n FROM sw GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 24")
def top_pathways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.population_matrix(*_pops(spark, sf_dir)).select(F.col("pre_pop").cast("long").alias("pre_pop"), F.col("post_pop").cast("long").alias("post_pop"), "n").orderBy(F.desc("n"), "pre_pop", "post_pop").limit(24)


@query(f"""WITH {_POPS}, al AS (SELECT region AS pop FROM su UNION SELECT pop FROM pp), i AS (SELECT post_pop AS pop, count(*) AS edges_in, max(abs(w)) AS strongest FROM sw GROUP BY 1), o AS (SELECT pre_pop AS pop, count(*) AS edges_out FROM sw GROUP BY 1)
SELECT pop::BIGINT AS pop, coalesce(edges_in, 0) AS edges_in, coalesce(edges_out, 0) AS edges_out, round(strongest, 6) AS strongest FROM al LEFT JOIN i USING (pop) LEFT JOIN o USING (pop)""")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fan(*_pops(spark, sf_dir)).select(F.col("pop").cast("long").alias("pop"), "edges_in", "edges_out", _r("strongest"))


@query("""WITH k AS (SELECT p_brand, p_type, count(*) AS kind_n FROM part GROUP BY 1, 2), r AS (SELECT *, (sum(kind_n) OVER (PARTITION BY p_brand))::BIGINT AS n, row_number() OVER (PARTITION BY p_brand ORDER BY kind_n DESC, p_type) AS nth FROM k)
SELECT p_brand, p_type, kind_n, n, nth, round(n / (SELECT count(*) FROM part), 6) AS share FROM r WHERE nth <= 3""")
def fan_in_out_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.census(table(spark, sf_dir, "part"), "p_brand", "p_type", 3)
    return c.select("p_brand", "p_type", "kind_n", F.col("n").cast("long").alias("n"), F.col("nth").cast("long").alias("nth"), _r("share"))


_PUSH = f"""{_POPS}, ps AS (SELECT post AS id, count(*) FILTER (s = 'a' AND w >= 0) AS ea, count(*) FILTER (s = 'a' AND w < 0) AS ia, count(*) FILTER (s = 'b' AND w >= 0) AS eb, count(*) FILTER (s = 'b' AND w < 0) AS ib
FROM (SELECT *, CASE WHEN pre % 2 = 0 THEN 'a' ELSE 'b' END AS s FROM sw WHERE pre % 5 < 4) GROUP BY post)"""


def _push(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = _pops(spark, sf_dir)
    s = suppliers(spark, sf_dir).filter("id % 5 < 4").select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("side"))
    return G.push_pull(e, s)


@query(f"WITH {_PUSH} SELECT id, ea, ia, eb, ib, (ea - ia) - (eb - ib) AS w FROM ps")
def push_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _push(spark, sf_dir)


@query(f"""WITH {_PUSH}, q AS (SELECT id % 2 = 0 AS r, ea + ia >= 3 AND eb + ib >= 3 AS bo, ea - ia AS p, eb - ib AS q FROM ps)
SELECT count(*) FILTER (bo) AS both_sides, count(*) FILTER (bo AND p * q < 0) AS opposite, count(*) FILTER (bo AND p > 0 AND q > 0) AS same_exc, count(*) FILTER (bo AND p < 0 AND q < 0) AS same_inh, round(avg(abs(p) + abs(q)) FILTER (bo), 6) AS mean_net,
count(*) FILTER (r) AS ring_n, count(*) FILTER (r AND bo) AS ring_both, count(*) FILTER (r AND bo AND p * q < 0) AS ring_opposite FROM q""")
def push_pull_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census of all receivers, and of those in a ring."""
    ring = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id")).filter("id % 2 = 0")
    return G.push_pull_census(_push(spark, sf_dir), ring=ring).withColumn("mean_net", F.round("mean_net", 6))


@query(f"WITH {SUPPLY_GRAPH} SELECT count(*) AS inputs, count(*) FILTER (pre % 8 = 0) AS from_patch, round(count(*) FILTER (pre % 8 = 0) / count(*), 6) AS share FROM sg WHERE post % 9 = 0")
def patch_input_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id")).filter("id % 9 = 0")
    return G.input_share(supply_graph(spark, sf_dir), suppliers(spark, sf_dir).filter("id % 8 = 0"), parts).select("inputs", "from_patch", _r("share"))


@query(f"""WITH {SUPPLY_GRAPH}, e AS (SELECT p_brand, count(*) AS n, count(DISTINCT pre) AS partners FROM sg JOIN part ON post = p_partkey + 1000000 WHERE pre % 2 = 0 GROUP BY 1)
SELECT p_brand, n, partners FROM e ORDER BY n DESC, p_brand LIMIT 25""")
def partner_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.between(supply_graph(spark, sf_dir), suppliers(spark, sf_dir).filter("id % 2 = 0"), table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("id")))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("post"), "p_brand")
    return e.join(p, "post").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pre").alias("partners")).orderBy(F.desc("n"), "p_brand").limit(25)


_SPLIT = """SELECT '{0}' AS axis, v AS cut, round(e, 6) AS explained FROM (SELECT v, nl * (n - nl) * (sl / nl - (s - sl) / (n - nl)) ** 2 / (n * n) / var AS e
FROM (SELECT v, sum(c) OVER (ORDER BY v) AS nl, sum(sv) OVER (ORDER BY v) AS sl, n, s, var FROM (SELECT {0} AS v, count(*)::DOUBLE AS c, sum({0}) AS sv FROM co GROUP BY 1), (SELECT count(*)::DOUBLE AS n, sum({0}) AS s, var_pop({0}) AS var FROM co)) WHERE nl < n ORDER BY round(e, 9) DESC, v LIMIT 1)"""


@query(f"WITH {COORDS}, al AS ({' UNION ALL '.join(f'({_SPLIT.format(a)})' for a in 'xyz')}) SELECT axis, round(cut, 6) AS cut, explained, row_number() OVER (ORDER BY explained DESC, axis) AS nth FROM al")
def midline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = coords(spark, sf_dir)
    x, y, z = (G.best_split(p, a).select(F.lit(a).alias("axis"), "cut", _r("explained")) for a in "xyz")
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("explained"), "axis")).cast("long")  # three rows
    return x.union(y).union(z).select("axis", _r("cut"), "explained", nth.alias("nth"))


_D2 = "pow(x - (SELECT avg(x) FROM co), 2) + pow(y - (SELECT avg(y) FROM co), 2) + pow(z - (SELECT avg(z) FROM co), 2)"


@query(f"WITH {COORDS} SELECT id, round(d2, 6) AS d2 FROM (SELECT id, {_D2} AS d2 FROM co) ORDER BY round(d2, 9), id LIMIT (SELECT round_even(0.25 * count(*), 0)::BIGINT FROM co)")
def compact_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.compact_patch(coords(spark, sf_dir), 0.25).select("id", _r("d2"))


@query(f"WITH {COORDS} SELECT count(*) AS n, round(median(sqrt({_D2})), 6) AS median_r, round(max(sqrt({_D2})), 6) AS max_r FROM co")
def patch_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spread(coords(spark, sf_dir)).select("n", _r("median_r"), _r("max_r"))


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5('patch|' || vec_id), vec_id LIMIT 100")
def random_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_patch(coords(spark, sf_dir), 100, "patch")


@query(f"""WITH {SUPPLY_GRAPH}, n AS (SELECT post AS id, sum(w) AS weight FROM sg GROUP BY post), k AS (SELECT *, round(-ln((('0x' || substr(md5('draw|' || id), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / weight, 12) AS k FROM n),
u AS (SELECT *, sum(weight) OVER (ORDER BY k) AS upto FROM k) SELECT id, round(weight, 6) AS weight FROM u WHERE upto - weight < 20000""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = supply_graph(spark, sf_dir).groupBy(F.col("post").alias("id")).agg(F.sum("w").alias("weight"))
    return G.weighted_sample(n, 20000, "draw").select("id", _r("weight"))


@query(f"""WITH {SUPPLY_GRAPH}, {COORDS}, e AS (SELECT post, s_nationkey AS kind, x, y, z FROM sg JOIN co ON pre = co.id JOIN supplier ON pre = s_suppkey), k AS (SELECT post, kind, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT post, kind AS top_kind, n AS top_n FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY n DESC, kind) AS r FROM k) WHERE r = 1)
SELECT post AS id, count(*) AS inputs, any_value(top_kind)::BIGINT AS top_kind, any_value(top_n) AS top_n, count(DISTINCT kind) AS kinds, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM e JOIN t USING (post) GROUP BY post""")
def centroid_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind"))
    r = G.receptive(supply_graph(spark, sf_dir), coords(spark, sf_dir), kinds)
    return r.select("id", "inputs", F.col("top_kind").cast("long").alias("top_kind"), "top_n", "kinds", *[_r(a) for a in "xyz"])


@query(f"WITH {EVENT_GRAPH}, a AS (SELECT DISTINCT pre AS id FROM eg) SELECT id, id IN (SELECT pre FROM eg WHERE cls = 'purchase' AND w > 60) AS buys, id IN (SELECT post FROM eg WHERE cls = 'error') AS errs FROM a")
def set_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    return G.indicators(e.select(F.col("pre").alias("id")), {"buys": e.filter("cls = 'purchase' and w > 60").select(F.col("pre").alias("id")), "errs": e.filter("cls = 'error'").select(F.col("post").alias("id"))})


@query(f"WITH {EVENT_GRAPH} SELECT post AS id, round(sum(w), 6) AS drive FROM eg WHERE pre IN (SELECT pre FROM eg WHERE pre % 6 = 0) GROUP BY post")
def spmv_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_graph(spark, sf_dir)
    return G.spread_step(e.filter("pre % 6 = 0").select(F.col("pre").alias("id")), e).select("id", _r("drive"))


@query(f"WITH {COORDS} SELECT a.id, b.id AS other, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM co a JOIN co b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.02 WHERE a.id <> b.id")
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coords(spark, sf_dir)
    return G.near(p, p, 0.02).filter("id <> other").select("id", "other", _r("d"))


@query("""SELECT doc_id AS id, 'mit' AS pattern, (len(text) - len(replace(text, 'MIT License', ''))) // 11 AS hits FROM documents WHERE contains(text, 'MIT License')
UNION ALL SELECT doc_id, 'version', (len(text) - len(replace(text, 'Version 2.0', ''))) // 11 FROM documents WHERE contains(text, 'Version 2.0')""")
def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.audit(table(spark, sf_dir, "documents"), "doc_id", "text", {"mit": "MIT License", "version": r"Version 2\.0"})


@query("SELECT doc_id, md5(replace(replace(text, 'Version 2.0', 'Version 2.1'), 'MIT License', 'MIT licence')) AS fixed FROM documents")
def document_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.substituted("text", [("Version 2.0", "Version 2.1"), ("MIT License", "MIT licence")]).cast("binary")).alias("fixed"))


@query(f"""WITH {COORDS}, n AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS index, c_custkey AS body_id, c_nationkey::BIGINT AS pop, n_name AS pop_name, n_regionkey::BIGINT AS cx_family, r_name AS cx_name, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y, round(coalesce(z, 0), 6) AS z, c_mktsegment AS cell_type
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN co ON co.id = c_custkey), {EVENT_GRAPH}
SELECT n.*, (cell_type = 'BUILDING')::BIGINT AS in_pool, (cell_type = 'MACHINERY')::BIGINT AS is_lptc, (body_id IN (SELECT post FROM eg WHERE cls = 'purchase'))::BIGINT AS is_relay, (x * x + y * y < 0.02)::BIGINT AS in_body_patch, (x > 0)::BIGINT AS positive_side, (abs(x) + abs(y) + abs(z) = 0)::BIGINT AS no_soma FROM n""")
def slice_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the cells of a slice: sixteen columns a cell."""
    from axonframe.functions.exprs import prefix_sums

    place = coords(spark, sf_dir).withColumnRenamed("id", "c_custkey")
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(named), F.col("c_nationkey") == F.col("n_nationkey")).join(place, "c_custkey", "left")
    c = prefix_sums(c, "c_custkey", {"k": F.lit(1)})
    nodes = c.select(
        (F.col("k") - 1).cast("long").alias("index"), F.col("c_custkey").alias("body_id"), F.col("c_nationkey").cast("long").alias("pop"), F.col("n_name").alias("pop_name"), F.col("n_regionkey").cast("long").alias("cx_family"), F.col("r_name").alias("cx_name"),
        *[F.round(F.coalesce(a, F.lit(0.0)), 6).alias(a) for a in "xyz"], F.col("c_mktsegment").alias("cell_type"),
    )
    ids = lambda df: df.select(F.col("body_id").alias("id"))
    sets = {"in_pool": ids(nodes.filter("cell_type = 'BUILDING'")), "is_lptc": ids(nodes.filter("cell_type = 'MACHINERY'")), "is_relay": event_graph(spark, sf_dir).filter("cls = 'purchase'").select(F.col("post").alias("id")), "in_body_patch": ids(nodes.filter("x * x + y * y < 0.02"))}
    flags = [*sets, "positive_side", "no_soma"]
    return G.slice_census(nodes, sets, "x", 0.0).withColumns({f: F.col(f).cast("long") for f in flags})
