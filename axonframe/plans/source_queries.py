"""Queries that go through a file format and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators import labels as L
from axonframe.sources import circuit, tables

from .catalogue import query
from .fixtures import coords, event_graph, table, trials


def _place(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type AS arm, event_id % 10 AS trial, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean_value, NULL::DOUBLE AS absent FROM events GROUP BY 1, 2")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide trial table through CSV: null stays null."""
    path = _place(spark, "csv")
    tables.write_csv(trials(spark, sf_dir).select("arm", "trial", "n", "mean_value", F.lit(None).cast("double").alias("absent")), path)
    return tables.read_trials(spark, path, {"arm": "string", "trial": "long"}).select("arm", "trial", "n", F.round("mean_value", 6).alias("mean_value"), "absent")


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, 0.0::DOUBLE AS z FROM embeddings")
def tsv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as text ``x,y`` in a TSV without a header: parsed by position, the missing part is 0."""
    path = _place(spark, "tsv")
    c = coords(spark, sf_dir)
    c.select("id", F.concat_ws(",", F.format_string("%.9f", "x"), F.format_string("%.9f", "y"), F.lit("n/a")).alias("place")).write.option("sep", "\t").csv(path)
    back = tables.read_positional(spark, path, [("id", "long"), ("place", "string"), ("extra", "double")], header=False)
    x, y, z = L.parsed_point("place")
    return back.select("id", x, y, z).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query("SELECT 'k' || (user_id % 7) AS kappa, count(*) AS n, round(avg(value), 4) AS rate FROM events GROUP BY 1")
def piped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A console log with bars between fields, parsed back; lines of other shapes are left out."""
    path = _place(spark, "log")
    s = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("kappa")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("rate"))
    lines = s.select(F.explode(F.array(F.concat_ws(" | ", "kappa", "n", "rate"), F.lit("kappa | n | rate"), F.lit("--"))).alias("value"))
    lines.write.text(path)
    return tables.read_piped_log(spark, path, [("kappa", "string"), ("n", "long"), ("rate", "double")])


@query("SELECT user_id AS pre, count(*) AS n, round(sum(value), 6) AS w FROM (SELECT user_id, value, lead(user_id) OVER (ORDER BY ts, event_id) AS post FROM events) WHERE post IS NOT NULL GROUP BY 1")
def circuit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event graph as a stored circuit (neurons, edges, groups, meta) and back."""
    path = _place(spark, "circuit")
    e = event_graph(spark, sf_dir)
    neurons = e.select(F.col("pre").alias("id")).union(e.select("post")).distinct().withColumn("population", (F.col("id") % 12).cast("int"))
    circuit.write_circuit(path, neurons, e.select("pre", "post", "w"), e.filter("cls = 'purchase'").select(F.lit("buyers").alias("name"), F.col("pre").alias("id")).distinct(), {"source": "events"})
    got = circuit.read_circuit(spark, path)
    return got["edges"].join(got["neurons"].select(F.col("id").alias("pre")), "pre").groupBy("pre").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("w"))
