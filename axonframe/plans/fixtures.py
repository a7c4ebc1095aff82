"""Graphs, spikes, trials and coordinates as projections of the driver's tables; each also as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, pre, post, w, cls``: each event's user and the next event's, in the order of time.

    The next event is looked for within a day; a day's last event takes the first of the next day that has any. So
    no task orders all events, and what is ordered over all days has one row a day.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type", F.to_date("ts").alias("day"))
    inside = W.partitionBy("day").orderBy("ts", "event_id")
    first = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("head"))
    first = first.select("day", F.lead("head").over(W.partitionBy(F.lit(0)).orderBy("day")).alias("next_head"))
    e = e.withColumn("next", F.lead("user_id").over(inside)).join(F.broadcast(first), "day")
    e = e.withColumn("post", F.coalesce("next", "next_head")).filter("post is not null")
    return e.select("event_id", F.col("user_id").alias("pre"), "post", F.col("value").alias("w"), F.col("event_type").alias("cls"))


EVENT_GRAPH = "eg AS (SELECT * FROM (SELECT event_id, user_id AS pre, lead(user_id) OVER (ORDER BY ts, event_id) AS post, value AS w, event_type AS cls FROM events) WHERE post IS NOT NULL)"


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``pre, post`` of strong purchase events, for questions about hops."""
    return event_graph(spark, sf_dir).filter("cls = 'purchase' and w > 60").select("pre", "post").distinct()


SPARSE_GRAPH = f"{EVENT_GRAPH}, sp AS (SELECT DISTINCT pre, post FROM eg WHERE cls = 'purchase' AND w > 60)"


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pre, post, w``: supplier to part, a row a line item."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pre"), (F.col("l_partkey") + 1000000).alias("post"), F.col("l_quantity").alias("w"))


SUPPLY_GRAPH = "sg AS (SELECT l_suppkey AS pre, l_partkey + 1000000 AS post, l_quantity AS w FROM lineitem)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, region``: suppliers with their region's key."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("region"))


SUPPLIERS = "su AS (SELECT s_suppkey AS id, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, z``: the first three components of each vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")])


COORDS = "co AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``neuron, arm, trial, t``: events as spikes; t in seconds from the first one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    start = e.agg(F.min("us")).first()[0] or 0
    return e.select(F.col("user_id").alias("neuron"), F.col("event_type").alias("arm"), (F.col("event_id") % 10).alias("trial"), ((F.col("us") - start) / 1e6).alias("t"), "value")


SPIKES = "sk AS (SELECT user_id AS neuron, event_type AS arm, event_id % 10 AS trial, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6 AS t, value FROM events)"

METRICS = ("n", "mean_value", "sd_value", "max_value", "users")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row an arm and trial, a column a metric."""
    e = table(spark, sf_dir, "events").withColumn("trial", F.col("event_id") % 10)
    return e.groupBy(F.col("event_type").alias("arm"), "trial").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("value").alias("mean_value"),
        F.stddev_samp("value").alias("sd_value"),
        F.max("value").alias("max_value"),
        F.countDistinct("user_id").cast("double").alias("users"),
    )


TRIALS = "tr AS (SELECT event_type AS arm, event_id % 10 AS trial, count(*)::DOUBLE AS n, avg(value) AS mean_value, stddev_samp(value) AS sd_value, max(value) AS max_value, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY ALL)"
LONG = TRIALS + ", lo AS (" + " UNION ALL ".join(f"SELECT arm, trial, '{m}' AS metric, {m} AS value FROM tr WHERE isfinite({m})" for m in METRICS) + ")"


def long_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arm, trial, metric, value``, one pass, no shuffle after the aggregation; finite values only."""
    from axonframe.operators.stats import to_long

    return to_long(trials(spark, sf_dir), ["arm", "trial"]).filter("finite").drop("finite")
