"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import dropped, saved


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each run of units, ``(size, count)`` by falling size, how many of them each shard gets.

    Units go one by one to the least-loaded shard, kept in a heap (ties: the smaller shard). A run of many equal units
    isn't walked through: the shard that starts at load x takes its units at x, x + size, ..., and the run takes the
    ``count`` smallest of all these loads, which a search over the level finds; what the heap does unit by unit gives the same.
    """
    load = [0] * shards
    out = []
    for size, count in sizes:
        got = [0] * shards
        if count <= 4 * shards:
            heap = [(x, s) for s, x in enumerate(load)]
            heapq.heapify(heap)
            for _ in range(count):
                x, s = heapq.heappop(heap)
                got[s] += 1
                heapq.heappush(heap, (x + size, s))
        else:
            under = lambda level: [max(0, -((x - level) // size)) for x in load]  # noqa: B023, E731  units that start below a level
            lo, hi = min(load), max(load) + size * (count // shards + 1) + 1
            while hi - lo > 1:  # the highest level under which no more than count start
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if sum(under(mid)) <= count else (lo, mid)
            got = under(lo)
            rest = count - sum(got)
            for s in range(shards):  # those that start right at the level, by shard
                if rest and load[s] + got[s] * size == lo:
                    got[s] += 1
                    rest -= 1
        load = [x + n * size for x, n in zip(load, got, strict=True)]
        out.append(got)
    return out


def shard_longest_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, lanes: int = 256, hot: int = 4096, most_sent: int = 500_000) -> DataFrame:
    """Rows with equal texts stay together; shard sizes in bytes come out near equal (law ``bytes``).

    All groups are scheduled, the largest first. Equal sizes are one run, so what comes to the driver is a row for each
    distinct group size: as sizes that differ add up to the total, at most the square root of twice all bytes, whatever
    the number of groups (14 million for 100 TB). A run's plan says how many of its groups each shard takes; its groups are
    numbered by hash lanes and a window inside each, so that no task orders a run, and take shards by number.

    Rows get their group's shard by a join on the group, in which the fewer than ``hot`` groups that hold more than one
    ``hot``-th of all rows go by broadcast and all others by shuffle: no task gets a hot group. Plans of up to ``most_sent``
    sizes are broadcast, longer ones are joined by size. Slots count each shard's rows from 0 without gaps: every shard
    is cut into ``lanes`` by a hash of the id, so that no task numbers a whole shard.

    A group heavier than a shard's fair share can't be split, as its rows must stay together; its shard is then
    larger than the rest. Null text: as the empty text (size 1). Null ids are kept and spread over the lanes by their text. Repeated rows each get a slot.
    Very long texts count by their bytes like all others. An empty table gives no rows. Other columns are ignored. ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"))
    lane_of = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("g")).otherwise(F.xxhash64("doc_id")), F.lit(lanes)).cast("int")
    base = saved(base.withColumn("lane", lane_of), "sizes")
    spark = docs.sparkSession
    groups = base.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = saved(groups.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(4096)).cast("int")), "groups")
    rows = groups.agg(F.sum("n")).first()[0] or 0
    runs = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("bytes")).toPandas()
    upto = np.cumsum(np.array(longest_first(zip(runs.bytes.tolist(), runs.c.tolist(), strict=True), shards), dtype=np.int64).reshape(-1, shards), axis=1)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(upto) + 1) * shards, pa.int32()), pa.array(upto.ravel()))
    plan = spark.createDataFrame(pa.table({"bytes": pa.array(runs.bytes.to_numpy(np.int64)), "upto": flat}))
    # a group's number in its run: the groups in the lanes before, and the place in its lane
    parts = groups.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("bytes").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("bytes", "part", before.alias("before"))
    place = F.row_number().over(W.partitionBy("bytes", "part").orderBy("g")) - 1
    numbered = groups.withColumn("place", place).join(parts, ["bytes", "part"]).select("g", "n", "bytes", (F.col("before") + F.col("place")).alias("k"))
    put = numbered.join(F.broadcast(plan) if len(runs) <= most_sent else plan.hint("merge"), "bytes")
    put = saved(put.select("g", "n", F.size(F.filter("upto", lambda u: u <= F.col("k"))).cast("int").alias("shard")), "shards")
    hot_groups = F.broadcast(put.filter(F.col("n") * hot > rows).select("g", "shard"))
    cold = base.join(hot_groups, "g", "left_anti").join(put.filter(F.col("n") * hot <= rows).select("g", "shard"), "g")
    known = ["doc_id", "size", "text_crc32", "lane", "shard"]
    got = saved(base.join(hot_groups, "g").select(*known).union(cold.select(*known)), "placed")
    dropped(base, groups, put)
    lane = got.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    lane = lane.select("shard", "lane", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # at most shards * lanes rows
    within = W.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    return (
        got.withColumn("at", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(lane), ["shard", "lane"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
