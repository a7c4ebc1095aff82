"""Operators on weighted directed edge tables ``pre, post, w``.

All are joins and partial aggregations on node ids; node sets are joined, never collected. Iterative ones write
each round's small result (:func:`axonframe.sources.tables.checkpointed`) so that a round never replays the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.functions.exprs import prefix_sums
from axonframe.functions.rng import hash_key, uniform
from axonframe.sources.tables import checkpointed


def _ids(nodes: DataFrame, name: str, flag: str | None = None) -> DataFrame:
    ids = nodes.select(F.col("id").alias(name)).distinct()
    return ids.withColumn(flag, F.lit(True)) if flag else ids


def endpoint_flags(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``pre_in`` and ``post_in``: whether an endpoint is among the nodes."""
    out = edges.join(_ids(nodes, "pre", "pre_in"), "pre", "left").join(_ids(nodes, "post", "post_in"), "post", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("pre_in", "post_in")})


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(_ids(nodes, "pre"), "pre", "left_semi").join(_ids(nodes, "post"), "post", "left_semi")


def frontier_scores(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``id, score``: nodes outside with the summed |w| of their edges to and from the selected ones."""
    f = endpoint_flags(edges, selected).filter("pre_in <> post_in")
    return f.groupBy(F.when(F.col("pre_in"), F.col("post")).otherwise(F.col("pre")).alias("id")).agg(F.sum(F.abs("w")).alias("score"))


def grow(edges: DataFrame, seeds: DataFrame, budget: int, rounds: int, per_round: int | None = None) -> DataFrame:
    """``id, round, score``: seeds (round 0), then each round the best outside nodes while there is room; ties by id.

    A round is a semi-join, an aggregation by candidate and a top-k that each task cuts to ``room`` rows first.
    """
    chosen = checkpointed(seeds.select("id").distinct().select("id", F.lit(0).alias("round"), F.lit(None).cast("double").alias("score")))
    size = chosen.count()
    for k in range(1, rounds + 1):
        room = min(budget - size, per_round or budget)
        if room <= 0:
            break
        best = frontier_scores(edges, chosen).orderBy(F.desc("score"), "id").limit(room)
        chosen = checkpointed(chosen.union(best.select("id", F.lit(k), "score")))
        size = chosen.count()
    return chosen


def reindexed(chosen: DataFrame) -> DataFrame:
    """``id, idx`` dense from 0 in the order of selection (round, score falling, id); a budget bounds the rows."""
    order = W.partitionBy(F.lit(0)).orderBy("round", F.desc_nulls_last("score"), "id")
    return chosen.select("id", (F.row_number().over(order) - 1).cast("long").alias("idx"))


def signed(edges: DataFrame, inhibitory: DataFrame, scale: float = 1.0) -> DataFrame:
    """Weights times ``scale``, negative where the sender is inhibitory; unknown senders stay positive."""
    out = edges.join(_ids(inhibitory, "pre", "neg"), "pre", "left")
    return out.withColumn("w", F.when(F.col("neg"), -F.col("w")).otherwise(F.col("w")) * scale).drop("neg")


def plastic(edges: DataFrame, senders: DataFrame, receivers: DataFrame, gain: float = 1.0) -> DataFrame:
    """``edges`` with ``plastic`` (from a sender to a receiver) and ``base_w``; plastic weights are ``gain`` times the base."""
    out = edges.join(_ids(senders, "pre", "s"), "pre", "left").join(_ids(receivers, "post", "r"), "post", "left")
    mask = F.coalesce(F.col("s") & F.col("r"), F.lit(False))
    return out.withColumn("plastic", mask).withColumn("base_w", F.col("w")).withColumn("w", F.when(mask, F.col("w") * gain).otherwise(F.col("w"))).drop("s", "r")


def silenced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing weights of the nodes set to 0."""
    return edges.join(_ids(nodes, "pre", "off"), "pre", "left").withColumn("w", F.when(F.col("off"), F.lit(0.0)).otherwise(F.col("w"))).drop("off")


def csr_offsets(edges: DataFrame, by: str = "pre") -> DataFrame:
    """``id, degree, row_start``: where a node's edges begin in an array ordered by ``by``; two-level prefix sums."""
    degree = edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    out = prefix_sums(degree, "id", {"upto": F.col("degree")})
    return out.select("id", "degree", (F.col("upto") - F.col("degree")).alias("row_start"))


def decimated(edges: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """Of each sender's edges the first by ``order``, as many as its share of the budget, at least one."""
    total = edges.count()
    degree = F.count(F.lit(1)).over(W.partitionBy("pre"))
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) * degree / F.lit(max(total, 1))))
    ranked = edges.withColumn("_share", share).withColumn("_nth", F.row_number().over(W.partitionBy("pre").orderBy(*order)))
    return ranked.filter("_nth <= _share").drop("_share", "_nth")


def hops(edges: DataFrame, seeds: DataFrame, most: int = 6) -> DataFrame:
    """``id, hop``: the fewest steps along edges from the seeds, up to ``most``; a frontier that no visited node re-enters."""
    links = edges.select("pre", "post").distinct()
    seen = checkpointed(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, most + 1):
        new = links.join(seen.filter(F.col("hop") == k - 1).select(F.col("id").alias("pre")), "pre", "left_semi").select(F.col("post").alias("id")).distinct()
        new = checkpointed(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(k)))
        if new.isEmpty():
            break
        seen = checkpointed(seen.union(new))
    return seen


def between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from a node of ``a`` to one of ``b``."""
    return edges.join(_ids(a, "pre"), "pre", "left_semi").join(_ids(b, "post"), "post", "left_semi")


def relays(edges: DataFrame, a: DataFrame, ring: DataFrame, b: DataFrame, least: int = 3) -> DataFrame:
    """``id, from_a, to_ring, to_b``: nodes outside A with ``least`` edges from A, and as many to the ring or to B."""
    into = edges.join(_ids(a, "pre"), "pre", "left_semi").groupBy(F.col("post").alias("id")).agg(F.count(F.lit(1)).alias("from_a"))
    out = edges.join(_ids(ring, "post", "in_ring"), "post", "left").join(_ids(b, "post", "in_b"), "post", "left").filter("in_ring or in_b")
    out = out.groupBy(F.col("pre").alias("id")).agg(F.count_if("in_ring").alias("to_ring"), F.count_if("in_b").alias("to_b")).filter(F.greatest("to_ring", "to_b") >= least)
    return into.filter(F.col("from_a") >= least).join(out, "id").join(_ids(a, "id"), "id", "left_anti")


def two_hop(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, n_in, n_out``: middle nodes between A and B with their edge counts on either side."""
    into = edges.join(_ids(a, "pre"), "pre", "left_semi").groupBy(F.col("post").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    out = edges.join(_ids(b, "post"), "post", "left_semi").groupBy(F.col("pre").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    return into.join(out, "id")


def population_matrix(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``pre_pop, post_pop, n, n_exc, n_inh, strength`` from ``of`` (``id, pop``)."""
    pre, post = of.select(F.col("id").alias("pre"), F.col("pop").alias("pre_pop")), of.select(F.col("id").alias("post"), F.col("pop").alias("post_pop"))
    return edges.join(pre, "pre").join(post, "post").groupBy("pre_pop", "post_pop").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") >= 0).alias("n_exc"), F.count_if(F.col("w") < 0).alias("n_inh"), F.sum(F.abs("w")).alias("strength")
    )


def chain_verdict(count: Column) -> Column:
    """Of a link's number of edges: broken, sparse or present."""
    return F.when(count == 0, "broken").when(count < 50, "sparse").otherwise("present")


def chain(matrix: DataFrame, links: list[tuple[str, list[int], list[int]]]) -> DataFrame:
    """``link, ord, n, verdict`` of named links, each from some populations to some others, by :func:`population_matrix`.

    Links hang on the stated table, not on the edges that are there, so one without any is broken and not missing.
    """
    pairs = [(name, k, p, q) for k, (name, a, b) in enumerate(links) for p in a for q in b]
    stated = matrix.sparkSession.createDataFrame(pairs, "link string, ord long, pre_pop long, post_pop long")
    found = matrix.select(F.col("pre_pop").cast("long").alias("pre_pop"), F.col("post_pop").cast("long").alias("post_pop"), "n")
    out = F.broadcast(stated).join(found, ["pre_pop", "post_pop"], "left").groupBy("link", "ord").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return out.withColumn("verdict", chain_verdict(F.col("n")))


def fan(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``pop, edges_in, edges_out, strongest``: by population, with the largest single |w| that comes in."""
    into = edges.join(of.select(F.col("id").alias("post"), "pop"), "post").groupBy("pop").agg(F.count(F.lit(1)).alias("edges_in"), F.max(F.abs("w")).alias("strongest"))
    out = edges.join(of.select(F.col("id").alias("pre"), "pop"), "pre").groupBy("pop").agg(F.count(F.lit(1)).alias("edges_out"))
    both = of.select("pop").distinct().join(into, "pop", "left").join(out, "pop", "left")
    return both.select("pop", F.coalesce("edges_in", F.lit(0)).alias("edges_in"), F.coalesce("edges_out", F.lit(0)).alias("edges_out"), "strongest")


def census(nodes: DataFrame, by: str, kind: str, k: int) -> DataFrame:
    """``by, n, share, kind, kind_n, nth``: sizes of classes and the ``k`` commonest kinds in each; ties by name."""
    kinds = nodes.groupBy(by, kind).agg(F.count(F.lit(1)).alias("kind_n"))
    w = W.partitionBy(by)
    total = nodes.count()
    out = kinds.withColumn("n", F.sum("kind_n").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("kind_n"), kind)))
    return out.filter(F.col("nth") <= k).withColumn("share", F.col("n") / F.lit(max(total, 1)))


def push_pull(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """By receiver, of senders on side a or b (``id, side``): excitatory and inhibitory counts, and w = (ea - ia) - (eb - ib)."""
    e = edges.join(sides.select(F.col("id").alias("pre"), "side"), "pre")
    n = lambda side, sign: F.count_if((F.col("side") == side) & ((F.col("w") >= 0) if sign > 0 else (F.col("w") < 0)))
    out = e.groupBy(F.col("post").alias("id")).agg(n("a", 1).alias("ea"), n("a", -1).alias("ia"), n("b", 1).alias("eb"), n("b", -1).alias("ib"))
    return out.withColumn("w", (F.col("ea") - F.col("ia")) - (F.col("eb") - F.col("ib")))


def push_pull_census(weights: DataFrame, least: int = 3, ring: DataFrame | None = None) -> DataFrame:
    """One row: receivers with ``least`` edges from each side, by the signs of the two sides' net input, and their mean |net| of both sides together.

    ``ring``: a subset of receivers, of which ``ring_n``, ``ring_both`` and ``ring_opposite`` are counted, too.
    """
    a, b = F.col("ea") - F.col("ia"), F.col("eb") - F.col("ib")
    both = (F.col("ea") + F.col("ia") >= least) & (F.col("eb") + F.col("ib") >= least)
    count = lambda c: F.count_if(both & c)
    columns = [F.count_if(both).alias("both_sides"), count(a * b < 0).alias("opposite"), count((a > 0) & (b > 0)).alias("same_exc"), count((a < 0) & (b < 0)).alias("same_inh"), F.avg(F.when(both, F.abs(a) + F.abs(b))).alias("mean_net")]
    if ring is not None:
        weights = weights.join(_ids(ring, "id", "in_ring"), "id", "left").withColumn("in_ring", F.coalesce("in_ring", F.lit(False)))
        columns += [F.count_if("in_ring").alias("ring_n"), count(F.col("in_ring")).alias("ring_both"), count(F.col("in_ring") & (a * b < 0)).alias("ring_opposite")]
    return weights.agg(*columns)


def input_share(edges: DataFrame, patch: DataFrame, target: DataFrame) -> DataFrame:
    """One row: edges into the target set, those from the patch, and their share."""
    e = edges.join(_ids(target, "post"), "post", "left_semi").join(_ids(patch, "pre", "p"), "pre", "left")
    return e.agg(F.count(F.lit(1)).alias("inputs"), F.count("p").alias("from_patch")).withColumn("share", F.col("from_patch") / F.nullif(F.col("inputs").cast("double"), F.lit(0.0)))


def best_split(points: DataFrame, axis: str) -> DataFrame:
    """One row, ``cut, explained``: the two-means split of a coordinate with the largest between / total variance; ties: the smallest cut.

    ``cut`` is the largest value on the left side. Prefix sums over bucketed values replace a window over all points.
    """
    p = points.filter(F.col(axis).isNotNull()).select(F.col(axis).alias("v"))
    grouped = p.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"))
    total = p.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.var_pop("v").alias("var")).first()
    if not total.n or not total["var"]:
        return p.sparkSession.createDataFrame([], "cut double, explained double")
    at = prefix_sums(grouped, "v", {"nl": F.col("c"), "sl": F.col("s")}).filter(F.col("nl") < total.n)
    nr, sr = F.lit(total.n) - F.col("nl"), F.lit(total.s) - F.col("sl")
    between_ = F.col("nl") * nr * F.pow(F.col("sl") / F.col("nl") - sr / nr, F.lit(2)) / float(total.n) ** 2
    return at.select(F.col("v").alias("cut"), (between_ / total["var"]).alias("explained")).orderBy(F.desc(F.round("explained", 9)), "cut").limit(1)


def compact_patch(points: DataFrame, fraction: float) -> DataFrame:
    """``id, d2``: the points nearest to the centroid, round(fraction * n) of them (half to even), ties by id."""
    c = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"]).first()
    d2 = sum((F.pow(F.col(a) - F.lit(c[a]), F.lit(2)) for a in "xyz"), F.lit(0.0))
    return points.select("id", d2.alias("d2")).orderBy(F.round("d2", 9), "id").limit(round(fraction * c.n))


def random_patch(points: DataFrame, size: int, seed: str) -> DataFrame:
    """``size`` ids in the order of their hash: each subset is as likely."""
    return points.select("id").orderBy(hash_key(seed, "id"), "id").limit(size)


def weighted_sample(nodes: DataFrame, target: float, seed: str) -> DataFrame:
    """``id, weight``: without replacement, by falling U^(1/weight), until the weights sum to the target.

    ``nodes``: ``id, weight``. An item is taken while what was taken before it is under the target.
    """
    keyed = nodes.filter("weight > 0").withColumn("k", F.round(-F.log((uniform(seed, "id") * 4294967296.0 + 1) / 4294967297.0) / F.col("weight"), 12))
    upto = prefix_sums(keyed, "k", {"upto": F.col("weight")})
    return upto.filter(F.col("upto") - F.col("weight") < target).select("id", "weight")


def receptive(edges: DataFrame, places: DataFrame, kinds: DataFrame) -> DataFrame:
    """By receiver: inputs, the commonest kind of sender (ties by name) with its count, distinct kinds, mean sender place."""
    e = edges.join(places.select(F.col("id").alias("pre"), "x", "y", "z"), "pre").join(kinds.select(F.col("id").alias("pre"), "kind"), "pre")
    by_kind = e.groupBy("post", "kind").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in "xyz"])
    top = F.max(F.struct("n", F.lit(0) - F.col("kind"))).alias("top")
    out = by_kind.groupBy(F.col("post").alias("id")).agg(F.sum("n").alias("inputs"), top, F.count(F.lit(1)).alias("kinds"), *[(F.sum(a) / F.sum("n")).alias(a) for a in "xyz"])
    return out.select("id", "inputs", (F.lit(0) - F.col("top.col2")).alias("top_kind"), F.col("top.n").alias("top_n"), "kinds", "x", "y", "z")


def spread(points: DataFrame) -> DataFrame:
    """One row: number of points, median and largest distance from their centroid."""
    c = points.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()
    r = F.sqrt(sum((F.pow(F.col(a) - F.lit(c[a]), F.lit(2)) for a in "xyz"), F.lit(0.0)))
    return points.select(r.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.median("r").alias("median_r"), F.max("r").alias("max_r"))


def indicators(universe: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """``id`` and a boolean for each named set."""
    out = universe.select("id").distinct()
    for name, s in sets.items():
        out = out.join(_ids(s, "id", name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def spread_step(active: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, drive``: the summed weights that one step's active nodes (``id``) send on."""
    return edges.join(_ids(active, "pre"), "pre", "left_semi").groupBy(F.col("post").alias("id")).agg(F.sum("w").alias("drive"))


def near(points: DataFrame, others: DataFrame, radius: float, places: bool = False) -> DataFrame:
    """``id, other, d``: pairs in the plane within a radius, by an equi-join on grid cells of that width.

    Each point looks into its own cell and the eight around it, so no pair of distant points is formed. ``places``:
    with both points' ``x, y, ox, oy``.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = points.select("id", "x", "y", around.alias("o")).select("id", "x", "y", (cell("x") + F.col("o.i")).alias("cx"), (cell("y") + F.col("o.j")).alias("cy"))
    b = others.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2)))
    return a.join(b, ["cx", "cy"]).select("id", "other", d.alias("d"), *(["x", "y", "ox", "oy"] if places else [])).filter(F.col("d") <= radius)


def slice_census(nodes: DataFrame, sets: dict[str, DataFrame], axis: str, middle: float) -> DataFrame:
    """A row a cell with its places, names and sets: ``nodes`` (``index, body_id, pop, pop_name, cx_family, cx_name, x, y, z, cell_type``) with 0 or 1
    for each set of ids (``in_pool, is_lptc, is_relay, in_body_patch``), ``positive_side`` of the middle and ``no_soma`` (all coordinates 0).
    """
    flags = indicators(nodes.select(F.col("body_id").alias("id")), sets).withColumnRenamed("id", "body_id")
    out = nodes.join(flags, "body_id")
    soma = F.abs("x") + F.abs("y") + F.abs("z")
    return out.select(*nodes.columns, *[F.col(n).cast("int").alias(n) for n in sets], (F.col(axis) > middle).cast("int").alias("positive_side"), (soma == 0).cast("int").alias("no_soma"))
