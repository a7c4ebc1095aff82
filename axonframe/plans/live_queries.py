"""Queries of the tick operators over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators import labels as L
from axonframe.sources.tables import shared_dir
from axonframe.streaming import live as V

from .catalogue import query
from .fixtures import COORDS, coords, table

BLOCK = 6 * 3600


def _r(*cols: str, digits: int = 6) -> list[F.Column]:
    return [F.round(c, digits).alias(c) for c in cols]


def _stamped(e: DataFrame) -> DataFrame:
    """Events as ``key, kind, ts (timestamp), value, event_id``; the table's clock is UTC."""
    return e.select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")


_BLOCKS = f"SELECT epoch_us(ts) // 1000000 // {BLOCK} * {BLOCK} AS start, event_type AS kind, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY 1, 2"


@query(_BLOCKS)
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.blocks(_stamped(table(spark, sf_dir, "events")), BLOCK, ["kind"]).select("start", "kind", "n", *_r("total", "low", "high"))


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(f"SELECT * FROM ({_BLOCKS}) WHERE start + {BLOCK} <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) / 1000")
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks as a stream: those that the watermark has closed."""
    run = lambda e: V.blocks(_stamped(e), BLOCK, ["kind"], late="1 hour")
    return V.replay(spark, f"{sf_dir}/events.parquet", _shared(spark), run).select("start", "kind", "n", *_r("total", "low", "high"))


@query("""WITH g AS (SELECT user_id AS key, count(*) AS n, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, v: a + 0.1 * (v - a)) AS level, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1)
SELECT key, n, round(level, 6) AS level, round(last, 6) AS last, CASE WHEN level < 40 THEN 'calm' WHEN level < 60 THEN 'busy' ELSE 'excited' END AS mood FROM g""")
def stream_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed leaky state of each user over the replayed events: its last update."""
    out = V.replay(spark, f"{sf_dir}/events.parquet", _shared(spark), lambda e: V.agents(_stamped(e)))
    last = out.groupBy("key").agg(F.max(F.struct("n", "level", "last", "mood")).alias("s"))
    return last.select("key", "s.n", F.round("s.level", 6).alias("level"), F.round("s.last", 6).alias("last"), "s.mood")


@query("SELECT user_id AS key, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, v: a + 0.1 * (v - a)), 6) AS level FROM events GROUP BY user_id")
def ema_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.leaky(_stamped(table(spark, sf_dir, "events")), ["key"], ["ts", "event_id"], "value", 0.1)
    return x.groupBy("key").agg(F.round(F.max_by("level", F.struct("ts", "event_id")), 6).alias("level"))


@query("SELECT key, count(*) FILTER (abs(value - prev) > 30) AS jumps FROM (SELECT user_id AS key, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY key")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jumps(_stamped(table(spark, sf_dir, "events")), ["key"], ["ts", "event_id"], "value", 30.0)


@query("""WITH f AS (SELECT event_type AS arm FROM events WHERE value > 90), a(arm, ord) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4)), n AS (SELECT a.arm, ord, count(f.arm) AS n FROM a LEFT JOIN f USING (arm) GROUP BY 1, 2)
SELECT arm, n, (SELECT min(n) >= 6 AND min(n) % 2 = 0 FROM n) AS due FROM n ORDER BY n, ord LIMIT 1""")
def adaptive_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = table(spark, sf_dir, "events").filter("value > 90").select(F.col("event_type").alias("arm"))
    arms = spark.createDataFrame([(a, k) for k, a in enumerate(["view", "click", "signup", "purchase", "error"])], "arm string, ord int")
    return V.least_filled(filled, arms).withColumn("k", F.lit(1)).join(V.report_due(filled, arms).withColumn("k", F.lit(1)), "k").select("arm", "n", "due")


@query("""WITH p AS (SELECT event_id, epoch_us(ts) / 1e6 AS born, value AS strength FROM events WHERE event_type = 'purchase')
SELECT event_id, round(1705000000 - born, 6) AS age, round(strength * (1 - (1705000000 - born) / 90000), 6) AS strength FROM p WHERE 1705000000 - born >= 0 AND 1705000000 - born < 90000""")
def ttl_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _stamped(table(spark, sf_dir, "events")).filter("kind = 'purchase'").select("event_id", (F.unix_micros("ts") / 1e6).alias("born"), F.col("value").alias("strength"))
    return V.alive(p, F.lit(1705000000.0), 90000.0).select("event_id", *_r("age", "strength"))


@query("SELECT event_type AS kind, arg_min(user_id, (value, user_id)) AS least, arg_min(user_id, (-value, user_id)) AS most FROM events GROUP BY 1")
def extreme_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extremes(_stamped(table(spark, sf_dir, "events")), ["kind"], "value", "key")


@query("""WITH u AS (SELECT user_id AS key, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT key, CASE WHEN coalesce(v, 0) <= 0 AND coalesce(c, 0) <= 0 AND coalesce(p, 0) <= 0 THEN 'none' WHEN coalesce(v, 0) >= coalesce(c, 0) AND coalesce(v, 0) >= coalesce(p, 0) THEN 'view' WHEN coalesce(c, 0) >= coalesce(p, 0) THEN 'click' ELSE 'purchase' END AS lead,
CASE WHEN v >= 60 THEN 'excited' WHEN v >= 45 THEN 'busy' ELSE 'calm' END AS mood, round(coalesce(v, 0) / (1 + coalesce(v, 0)), 6) AS squashed FROM u""")
def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moods and leading kinds by means that no order of rows changes, as they are held against thresholds and each other."""
    from axonframe.functions.exprs import exact_mean, squash

    mean = lambda k: exact_mean(F.when(F.col("event_type") == k, F.col("value")))
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(mean("view").alias("v"), mean("click").alias("c"), mean("purchase").alias("p"))
    return u.select("key", L.dominant([("view", "v"), ("click", "c"), ("purchase", "p")], "none").alias("lead"), L.ladder("v", [(60.0, "excited"), (45.0, "busy")], "calm").alias("mood"), F.round(squash(F.coalesce("v", F.lit(0.0))), 6).alias("squashed"))


@query(f"""WITH {COORDS}, p AS (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, floor((degrees(atan2(b.y - a.y, b.x - a.x)) + 120) / 15) AS ray FROM co a JOIN co b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05)
SELECT id, ray::BIGINT AS ray, count(*) AS seen, round(min(d), 6) AS nearest FROM p WHERE ray >= 0 AND ray < 16 GROUP BY 1, 2""")
def sight_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = coords(spark, sf_dir)
    return V.sight(p, p, reach=0.05).select("id", F.col("ray").cast("long").alias("ray"), "seen", *_r("nearest"))


@query(f"WITH {COORDS} SELECT id % 10 AS class, round(count(DISTINCT (floor(x / 0.05), floor(y / 0.05))) / 400, 6) AS share FROM co GROUP BY 1")
def grid_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.occupancy(coords(spark, sf_dir).withColumn("class", F.col("id") % 10), ["class"], 0.05, 400).select("class", *_r("share"))


@query("SELECT user_id AS id, user_id % 12 AS gx, (user_id // 12) % 10 AS gy, round(least(1, greatest(0, count(*) / 30.0::DOUBLE / 4)), 6) AS heat FROM events GROUP BY user_id")
def neuron_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.count(F.lit(1)) / 30.0).alias("rate"))
    return V.grid_heat(r, 12, 10).select("id", "gx", "gy", *_r("heat"))


@query("""WITH l AS (SELECT user_id % 12 AS population, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, v: a + 0.1 * (v - a)) AS level FROM events GROUP BY user_id)
SELECT population, count(*) AS cells, round(sum(level), 6) AS total, round(avg(level), 6) AS meter, count(*) FILTER (level < 15) AS bar0, count(*) FILTER (level >= 15 AND level < 30) AS bar1, count(*) FILTER (level >= 30 AND level < 45) AS bar2, count(*) FILTER (level >= 45) AS bar3 FROM l GROUP BY population""")
def population_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' leaky levels by population: sums, means and a histogram."""
    x = V.leaky(_stamped(table(spark, sf_dir, "events")), ["key"], ["ts", "event_id"], "value", 0.1)
    last = x.groupBy("key").agg(F.max_by("level", F.struct("ts", "event_id")).alias("level")).withColumn("population", F.col("key") % 12)
    return V.population_meters(last, 15.0, 4).select("population", "cells", *_r("total", "meter"), *[f"bar{k}" for k in range(4)])


@query("""WITH f AS (SELECT user_id AS key, ts, event_id, abs(value - lag(value, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS motion FROM events),
g AS (SELECT key, list_reduce(list_prepend(0.0::DOUBLE, list(motion ORDER BY ts, event_id)), lambda a, v: a + 0.4 * (v - a)) AS level FROM f WHERE motion IS NOT NULL GROUP BY key) SELECT key, round(level, 6) AS level FROM g""")
def view_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the fourth frame before, smoothed."""
    from pyspark.sql import Window as W

    e = _stamped(table(spark, sf_dir, "events"))
    m = e.withColumn("motion", F.abs(F.col("value") - F.lag("value", 4).over(W.partitionBy("key").orderBy("ts", "event_id")))).filter("motion is not null")
    x = V.leaky(m, ["key"], ["ts", "event_id"], "motion", 0.4)
    return x.groupBy("key").agg(F.round(F.max_by("level", F.struct("ts", "event_id")), 6).alias("level"))


_RAY = """WITH RECURSIVE co AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), wa AS (SELECT DISTINCT floor(x / 0.02) AS gx, floor(y / 0.02) AS gy FROM co WHERE label = 0),
d AS (SELECT id, x, y, ray, radians(240) * (ray / 15 - 0.5::DOUBLE) AS a FROM co, (SELECT unnest(range(16)) AS ray)), u AS (SELECT *, cos(a) / sqrt(pow(cos(a), 2) + pow(sin(a) * 0.35, 2)) AS ux, sin(a) * 0.35 / sqrt(pow(cos(a), 2) + pow(sin(a) * 0.35, 2)) AS uy FROM d),
st AS (SELECT id, ray, s, floor((x + ux * (s * (0.25::DOUBLE / 14))) / 0.02) AS gx, floor((y + uy * (s * (0.25::DOUBLE / 14))) / 0.02) AS gy FROM u, (SELECT unnest(range(1, 15)) AS s)),
h AS (SELECT id, ray, min(s) FILTER (wa.gx IS NOT NULL) AS hit FROM st LEFT JOIN wa USING (gx, gy) GROUP BY 1, 2)
SELECT id, ray, coalesce(hit, 0) AS hit, round(hit * (0.25::DOUBLE / 14), 6) AS distance, round(coalesce(1 - hit / 14.0::DOUBLE * 0.7, 0), 6) AS energy FROM h"""


@query(_RAY)
def ray_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point looks along sixteen rays; points of one label are walls."""
    p = coords(spark, sf_dir).withColumn("heading", F.lit(0.0))
    walls = table(spark, sf_dir, "embeddings").filter("label = 0").select(*[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xy")])
    return V.ray_walk(p, walls, 0.02, reach=0.25).select("id", F.col("ray").cast("long").alias("ray"), F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), *_r("distance", "energy"))


@query("""WITH t AS (SELECT user_id AS key, ts, event_id, value / 50 - 1 AS turn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events),
g AS (SELECT key, list(value ORDER BY k) AS v, list(turn ORDER BY k) AS u FROM t GROUP BY key),
l AS (SELECT key, unnest(range(1, len(v) + 1)) AS k, u, v FROM g),
s AS (SELECT key, k, list_reduce(list_prepend(0.0::DOUBLE, v[1:k]), lambda a, x: a + 0.15 * (x - a)) AS speed, list_sum(list_transform(u[1:k], lambda x: x * 0.1)) AS heading FROM l)
SELECT key, count(*) AS ticks, round(arg_max(heading, k), 6) AS heading, round(sum(speed * cos(heading) * 0.1), 5) AS px, round(sum(speed * sin(heading) * 0.1), 5) AS py FROM s GROUP BY key""")
def agent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sense, motor and place of each user's agent: a value is what it turns and speeds up by; where it is after its last tick."""
    e = _stamped(table(spark, sf_dir, "events")).withColumn("turn", F.col("value") / 50 - 1)
    moved = V.integrated(V.leaky(e, ["key"], ["ts", "event_id"], "value", 0.15), ["key"], ["ts", "event_id"], "turn", "level", 0.1)
    last = moved.groupBy("key").agg(F.count(F.lit(1)).alias("ticks"), F.max_by(F.struct("heading", "px", "py"), F.struct("ts", "event_id")).alias("s"))
    return last.select("key", "ticks", F.round("s.heading", 6).alias("heading"), F.round("s.px", 5).alias("px"), F.round("s.py", 5).alias("py"))


@query(f"""WITH w AS (SELECT epoch_us(ts) // 1000000 // {BLOCK} * {BLOCK} AS start, user_id AS key, count(*) AS n, round(arg_max(value, (ts, event_id)), 6) AS last FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + {BLOCK} <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events) / 1000""")
def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last value in every window as a stream's log: the windows that the watermark has closed."""
    run = lambda e: V.snapshots(_stamped(e), BLOCK, late="1 hour")
    return V.replay(spark, f"{sf_dir}/events.parquet", _shared(spark), run).select("start", "key", "n", *_r("last"))
