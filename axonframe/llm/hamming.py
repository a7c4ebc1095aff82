"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import dropped, hot_keys, salted_join, saved


def segment_widths(dims: int, rows: int) -> list[int]:
    """Lengths of a code's segments: about log2 of the rows each (the multi-index rule), 4 to 16, evenly cut."""
    want = max(4, min(16, rows.bit_length() - 1))
    m = max(-(-dims // 16), round(dims / want), 1)
    return [dims // m + (j < dims % m) for j in range(m)]


def sign_codes(vectors: DataFrame, widths: list[int], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and segments ``s0, s1, ...`` of the signs of the components: bit i of a segment is its i-th component > 0.

    Components that are null or not a number give 0, as do those missing in a short vector; null vectors have no code.
    """

    def segment(j: int) -> Column:
        first = sum(widths[:j])
        bits = [F.when(F.try_element_at("v", F.lit(first + i + 1)) > 0, 1 << i).otherwise(0) for i in range(widths[j])]
        return reduce(lambda a, b: a + b, bits).cast("int").alias(f"s{j}")

    v = F.transform(vec_col, lambda x: F.when(~F.isnan(x), x))
    return vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).select("id", *[segment(j) for j in range(len(widths))])


def masks(bits: int, radius: int) -> list[int]:
    """All flips of exactly ``radius`` of ``bits`` bits."""
    return [sum(1 << i for i in at) for at in combinations(range(bits), radius)]


def nearest_codes(codes: DataFrame, queries: DataFrame, widths: list[int], k: int = 10) -> DataFrame:
    """The ``k`` nearest codes of each query by Hamming distance, ties by the smaller id; exact.

    ``codes`` and ``queries`` have ``id`` and the same segment columns ``s0, s1, ...`` (see :func:`sign_codes`). A
    query's own id is no neighbour of it. Returns ``query_id, rank, id, distance``.

    The index has each distinct code once, with its ``k + 1`` smallest ids (a code's other rows can't be among the k
    nearest), so a code that a third of all rows share is one entry; the ranks are cut in every task before the shuffle.
    Round r probes all segment values at exactly r flips from the query's, segment by segment; a code is found
    when some segment lies within the radius, and its whole distance is then verified. With M segments all searched
    to radius r, each code within M (r + 1) - 1 flips has been found (pigeonhole), so a query whose k-th verified
    distance is at most that is done, and only the others go on. Probes are an equi-join on (segment, value) that
    never pairs all codes with a query until the radius itself covers a whole segment; the codes of a value that very many share are
    dealt to several tasks, each with the probes of that value. The flips of a radius are a
    table of at most 12,870 rows for each of two segment lengths, which is broadcast.

    Fewer than k other rows: all of them, after the last radius. No queries or no codes: no rows. Null ids aren't searched for nor found.
    """
    segs = [c for c in codes.columns if c.startswith("s")]
    m = len(segs)
    spark = codes.sparkSession
    small = W.partitionBy(*segs).orderBy("id")
    coded = codes.filter("id is not null").select("id", *segs).distinct()
    entries = coded.withColumn("nth", F.row_number().over(small)).filter(F.col("nth") <= k + 1).groupBy(*segs).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = saved(entries, "codes")
    index = entries.select("*", F.posexplode(F.array(*segs)).alias("seg", "value")).select("seg", "value", "ids", *segs)
    counts = index.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("m"))
    hot = saved(hot_keys(counts, ["seg", "value"], entries.count() * m), "hot", 0)
    todo = saved(queries.filter("id is not null").select(F.col("id").alias("query_id"), *[F.col(s).alias(f"q{s}") for s in segs]).distinct(), "queries")
    found = None  # the best so far of queries not done: query_id, id, distance
    out, held = [], []
    for radius in range(max(widths) + 1):
        flips = spark.createDataFrame([(w, x) for w in sorted(set(widths)) for x in masks(w, radius)], "width int, flip int")
        probes = todo.select("*", F.posexplode(F.array(*[f"q{s}" for s in segs])).alias("seg", "qvalue"))
        probes = probes.withColumn("width", F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("seg") + 1)).join(F.broadcast(flips), "width")
        probes = probes.withColumn("value", F.col("qvalue").bitwiseXOR(F.col("flip"))).drop("qvalue", "flip", "width")
        distance = reduce(lambda a, b: a + b, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"q{s}"))) for s in segs])
        # a code met in several segments is taken in the first of its least flipped ones
        flipped = [F.bit_count(F.col(s).bitwiseXOR(F.col(f"q{s}"))) for s in segs]
        first = F.array_position(F.array(*[(x <= radius) for x in flipped]), F.lit(True)) - 1
        new = reduce(lambda a, b: a & b, [x >= radius for x in flipped])  # nothing of it was within the last radius
        met = salted_join(index, probes, ["seg", "value"], F.broadcast(hot), segs, "merge")  # probes are far more than their table's size tells
        hits = met.filter(new & (F.col("seg") == first)).select("query_id", F.explode("ids").alias("id"), distance.cast("int").alias("distance")).filter("id != query_id")
        if found is not None:
            hits = hits.unionByName(found)
        by = W.partitionBy("query_id").orderBy("distance", "id")
        best = hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        done = F.count(F.lit(1)).over(W.partitionBy("query_id")) == k
        reach = F.lit(m * (radius + 1) - 1)
        best = saved(best.withColumn("done", done & (F.max("distance").over(W.partitionBy("query_id")) <= reach) | F.lit(radius == max(widths))), "nearest")
        held.append(best)
        out.append(best.filter("done").select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance"))
        left = saved(todo.join(best.filter("done").select("query_id").distinct(), "query_id", "left_anti"), "queries")
        dropped(todo)
        todo = left
        if todo.isEmpty():
            break
        found = best.filter("not done").select("query_id", "id", "distance")
    got = saved(reduce(lambda a, b: a.unionByName(b), out), "ranks")
    dropped(entries, hot, todo, *held)
    return got


def top_k(vectors: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest sign codes of each vector whose id is divisible by ``every``, against all rows: ``query_id, rank, vec_id, distance``.

    The code's length is that of the longest vector; a long one makes more segments. See :func:`sign_codes` and :func:`nearest_codes` for nulls, ties and repeated rows.
    """
    dims, n = vectors.agg(F.max(F.size(vec_col)), F.count(vec_col)).first()
    widths = segment_widths(max(dims or 0, 1), n)
    codes = saved(sign_codes(vectors, widths, id_col, vec_col), "signs")
    got = nearest_codes(codes, codes.filter(F.col("id") % every == 0), widths, k)
    dropped(codes)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")
