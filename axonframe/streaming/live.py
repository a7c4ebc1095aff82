"""Operators over streams of events ``key, ts, kind, value``.

Batch and streaming forms of the window operators are the same code. In a stream, a watermark bounds the state;
rows later than it are dropped by Spark, which is the only case in which batch and stream differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def blocks(events: DataFrame, seconds: int, by: list[str], late: str | None = None) -> DataFrame:
    """``start, by, n, total, low, high``: tumbling windows of event time. ``late``: the watermark, for a stream."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.unix_timestamp("w.start").alias("start"), *by, "n", "total", "low", "high")


def alive(patches: DataFrame, now: Column, lifetime: float) -> DataFrame:
    """Patches younger than their lifetime, with linearly decayed ``strength``; ``patches``: ``born`` in seconds."""
    age = now - F.col("born")
    return patches.withColumn("age", age).filter((age >= 0) & (age < lifetime)).withColumn("strength", F.col("strength") * (1 - F.col("age") / lifetime))


def leaky(events: DataFrame, by: list[str], order: list[str], value: str, k: float, chunk: int = 64) -> DataFrame:
    """``events`` with ``level``: x += k * (value - x) from 0 along each key's order.

    A key's rows are cut into chunks. Inside one the recursion is a weighted running sum; between chunks the level
    fades by (1 - k)^chunk, so a chunk depends on as many chunks before it as matter in double precision, by lag.
    """
    keep = 1 - k
    chunk = max(chunk, math.ceil(0.5 / k))  # few lags for a slow level, too
    fade = keep**chunk
    reach = max(1, math.ceil(-37 / math.log(fade))) if 0 < fade < 1 else 1  # 3 / (k * chunk) lags or so
    w = W.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("_i", F.row_number().over(w) - 1).withColumn("_chunk", F.floor(F.col("_i") / chunk)).withColumn("_r", F.col("_i") % chunk)
    scaled = F.sum(F.col(value) * F.pow(F.lit(keep), -F.col("_r"))).over(W.partitionBy(*by, "_chunk").orderBy("_r"))
    rows = rows.withColumn("_part", F.lit(k) * scaled * F.pow(F.lit(keep), F.col("_r")))
    ends = rows.groupBy(*by, "_chunk").agg(F.max_by("_part", "_r").alias("_end"))
    back = W.partitionBy(*by).orderBy("_chunk")
    level = sum((F.coalesce(F.lag("_end", m).over(back), F.lit(0.0)) * fade ** (m - 1) for m in range(1, reach + 1)), F.lit(0.0))
    ends = ends.select(*by, "_chunk", level.alias("_before"))
    out = rows.join(ends, [*by, "_chunk"])
    return out.withColumn("level", F.col("_part") + F.col("_before") * F.pow(F.lit(keep), F.col("_r") + 1)).drop("_i", "_chunk", "_r", "_part", "_before")


def jumps(series: DataFrame, by: list[str], order: list[str], value: str, least: float) -> DataFrame:
    """``by, jumps``: neighbours that differ by more than ``least``."""
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))
    return series.withColumn("_step", step).groupBy(*by).agg(F.count_if(F.col("_step") > least).alias("jumps"))


def extremes(points: DataFrame, by: list[str], value: str, what: str) -> DataFrame:
    """``by, least, most``: the item with the smallest and the largest value; ties by item."""
    return points.groupBy(*by).agg(F.min_by(what, F.struct(value, what)).alias("least"), F.min_by(what, F.struct(-F.col(value), F.col(what))).alias("most"))


def least_filled(filled: DataFrame, arms: DataFrame) -> DataFrame:
    """``arm, n``: the arm with the fewest blocks, ties by the arms' order. ``filled``: a row a block with its ``arm``."""
    n = arms.join(filled.groupBy("arm").agg(F.count(F.lit(1)).alias("n")), "arm", "left").select("arm", "ord", F.coalesce("n", F.lit(0)).alias("n"))
    return n.orderBy("n", "ord").limit(1).select("arm", "n")


def report_due(filled: DataFrame, arms: DataFrame, least: int = 6) -> DataFrame:
    """One row, ``due``: all arms have ``least`` blocks and the smallest count is even."""
    n = arms.join(filled.groupBy("arm").agg(F.count(F.lit(1)).alias("n")), "arm", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(((F.min("n") >= least) & (F.min("n") % 2 == 0)).alias("due"))


def heading_command(turn: Column, flee: Column, taxis: Column) -> Column:
    """An agent's turn: fleeing overrides, else brain turn and odour taxis add up; clamped to [-1, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.when(F.abs(flee) > 0, flee).otherwise(turn + 0.5 * taxis)))


def agent_motion(agents: DataFrame) -> DataFrame:
    """Of ``turn, forward, taxis, flee, alarm, smell, wander, speed``: ``agents`` with ``turn_rate`` and ``new_speed``.

    With a brain (``turn`` isn't null) its turn, taxis and flight add up, and speed nears its forward drive, at least
    what an alarm asks for. Without one an agent wanders the more the less it smells, and heads for food.
    """
    c = F.col
    near = lambda target: c("speed") + 0.15 * (target - c("speed"))
    led = near(F.least(F.lit(90.0), F.greatest(F.lit(0.0), c("forward") * 90)))
    led = F.when(c("alarm") > 0.05, F.greatest(led, 120 * c("alarm"))).otherwise(led)
    brain = c("turn").isNotNull()
    turn = F.when(brain, c("turn") * 2.2 + c("taxis") + F.when(c("alarm") > 0.05, c("flee")).otherwise(0.0)).otherwise(c("wander") * (1 - c("smell")) + c("taxis") * (0.4 + c("smell")))
    return agents.withColumns({"turn_rate": turn, "new_speed": F.when(brain, led).otherwise(near(20 + 70 * c("smell") + 120 * c("alarm")))})


def grid_heat(cells: DataFrame, width: int, height: int, scale: float = 4.0) -> DataFrame:
    """``gx, gy, heat``: cells laid out by index on a grid, heat = rate / ``scale`` clamped to [0, 1]."""
    heat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rate") / scale))
    return cells.select("id", (F.col("id") % width).alias("gx"), (F.floor(F.col("id") / width) % height).alias("gy"), heat.alias("heat"))


def population_meters(levels: DataFrame, width: float, bars: int) -> DataFrame:
    """Of ``population, level``: cells, summed and mean leaky level, and a histogram of ``bars`` bars of a width, the last one open."""
    bar = F.least(F.lit(bars - 1), F.greatest(F.lit(0), F.floor(F.col("level") / width)))
    return levels.withColumn("_bar", bar).groupBy("population").agg(F.count(F.lit(1)).alias("cells"), F.sum("level").alias("total"), F.avg("level").alias("meter"), *[F.count_if(F.col("_bar") == k).alias(f"bar{k}") for k in range(bars)])


def occupancy(points: DataFrame, by: list[str], cell: float, grid_cells: int) -> DataFrame:
    """``by, share`` of a grid's cells that hold a point."""
    return points.groupBy(*by).agg((F.countDistinct(F.struct(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell))) / F.lit(float(grid_cells))).alias("share"))


def sight(points: DataFrame, others: DataFrame, rays: int = 16, spread_deg: float = 240.0, reach: float = 1.0) -> DataFrame:
    """``id, ray, seen, nearest``: others within reach in each ray's sector, by the grid join of :func:`axonframe.operators.graph.near`."""
    from axonframe.operators.graph import near

    at = near(points, others, reach, places=True).filter("id <> other")
    angle = F.degrees(F.atan2(F.col("oy") - F.col("y"), F.col("ox") - F.col("x")))
    ray = F.floor((angle + spread_deg / 2) / (spread_deg / rays))
    return at.withColumn("ray", ray).filter((F.col("ray") >= 0) & (F.col("ray") < rays)).groupBy("id", "ray").agg(F.count(F.lit(1)).alias("seen"), F.min("d").alias("nearest"))


def ray_walk(eyes: DataFrame, walls: DataFrame, cell: float, rays: int = 16, samples: int = 14, spread_deg: float = 240.0, reach: float = 1.0, flat: float = 0.35) -> DataFrame:
    """``id, ray, hit, distance, energy``: sight along rays that end at the first wall.

    ``eyes``: ``id, x, y, heading``; ``walls``: ``x, y`` of what blocks, in squares of a width of ``cell``. Rays spread evenly around the heading, their
    height pressed by ``flat``. Each is looked at in ``samples`` places; the first in a walled square ends it, with an energy of
    1 less 0.7 times its share of the way. ``hit`` is that sample's number from 1; without a wall it is null and the energy 0. An equi-join on squares.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    blocked = walls.select(at("x").alias("gx"), at("y").alias("gy")).distinct()
    turn = F.col("heading") - math.radians(spread_deg) / 2 + math.radians(spread_deg) * (F.col("ray") / max(1, rays - 1))
    each = eyes.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1)))).withColumn("_dx", F.cos(turn)).withColumn("_dy", F.sin(turn) * flat)
    each = each.withColumn("_d", F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    step = F.col("s") * (reach / samples)
    each = each.select("id", "ray", "s", F.floor((F.col("x") + F.col("_dx") / F.col("_d") * step) / cell).alias("gx"), F.floor((F.col("y") + F.col("_dy") / F.col("_d") * step) / cell).alias("gy"))
    met = each.join(blocked.withColumn("_wall", F.lit(True)), ["gx", "gy"], "left").groupBy("id", "ray").agg(F.min(F.when(F.col("_wall"), F.col("s"))).alias("hit"))
    return met.select("id", "ray", "hit", (F.col("hit") * (reach / samples)).alias("distance"), F.coalesce(1 - F.col("hit") / float(samples) * 0.7, F.lit(0.0)).alias("energy"))


def integrated(ticks: DataFrame, by: list[str], order: list[str], turn: str, speed: str, dt: float) -> DataFrame:
    """``ticks`` with ``heading, px, py``: turns summed to headings, and steps along them to places, from 0, along each key's order."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    at = ticks.withColumn("heading", F.sum(F.col(turn) * dt).over(w))
    return at.withColumn("px", F.sum(F.col(speed) * F.cos("heading") * dt).over(w)).withColumn("py", F.sum(F.col(speed) * F.sin("heading") * dt).over(w))


def snapshots(events: DataFrame, seconds: int, late: str | None = None) -> DataFrame:
    """``start, key, n, last``: each key's last value in every window of ``seconds``, as a log is written at intervals; ``late``: the watermark, for a stream."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id", "value")).alias("at"))
    return out.select(F.unix_timestamp("w.start").alias("start"), "key", "n", F.col("at.value").alias("last"))


READOUT = "key long, n long, level double, last double, mood string"


def _advance(k: float, lifetime_ms: int) -> object:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # nothing for a lifetime: the agent is gone
            state.remove()
            return
        n, level, last = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            level += k * (float(v) - level)
            last = float(v)
            n += 1
        state.update((n, level, last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + lifetime_ms)
        yield pd.DataFrame({"key": [int(key[0])], "n": [n], "level": [level], "last": [last], "mood": ["calm" if level < 40 else "busy" if level < 60 else "excited"]})

    return run


def agents(events: DataFrame, k: float = 0.1, lifetime: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A stream's agents: each ``key`` has its leaky level as keyed state, which expires after a lifetime without an event."""
    ms = int(pd.Timedelta(lifetime).total_seconds() * 1000)
    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(_advance(k, ms), READOUT, "n long, level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, path: str, out: str, transform: object, mode: str = "append") -> DataFrame:
    """Runs a stream over all files that are there now, into a Parquet sink with its own checkpoint, and reads what it wrote.

    ``path`` is a Parquet file or a folder of them. A run that was stopped goes on from its checkpoint.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = transform(source.parquet(f"{folder}/{name}*"))
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
