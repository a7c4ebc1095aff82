"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: The modulus of the permutations' round function: a prime under 2**31, so that products of two remainders fit a long.
PRIME = 2147483647
ROUNDS = 4
#: Slots that one row of the plan stands for before it is multiplied out, and slots a task makes.
CHUNK, TASK_SLOTS = 8192, 500_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words wanted of each source. ``sizes``: ``no_src`` (the source is null), ``src``, ``source_size``.

    Sources by code point, null last, get the weights in turn. They split ``share`` times all words by weight, but
    none gets over ``cap`` times its own; what is over is shared again by weight among the rest until none is
    above. In closed form: with sources by rising cap / weight, a prefix stops at its cap and the others get one
    common level times their weight. One row a source, so the windows over all of them are small.
    """
    all_ = W.partitionBy(F.lit(0))
    by = all_.orderBy("ratio", "nth")
    got = (
        sizes.withColumn("nth", F.row_number().over(all_.orderBy("no_src", "src")))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(all_) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open_weight"))
        # the first source whose cap is not under the level it would get ends the prefix
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(all_))
    )
    level = F.coalesce(F.col("final.level"), F.lit(float("inf")))
    return got.select("no_src", "src", "source_size", "nth", F.least("cap", level * F.col("weight")).alias("target"))


def _hash(*parts: Column) -> Column:
    """52 bits of the md5 of the parts joined by ``|``; the same in any engine that has md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """The same for rows with the same id, source and text; never null."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(source_col).isNull().cast("string"), F.xxhash64(text_col).cast("string"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).cast("binary"))


def _round(r: str, key: str) -> str:
    """The round function: a cubic of the remainder, keyed by 52 bits; under 2**31."""
    z = f"(({r} + {key} % {PRIME}) % {PRIME})"
    return f"(({z} * {z} % {PRIME} * {z} + {key} div {PRIME}) % {PRIME})"


def permuted(df: DataFrame, x: str, n: str, keys: str, out: str) -> DataFrame:
    """``df`` with ``out``: the image of ``x`` under a pseudorandom permutation of 0 ... n - 1, keyed by an array of :data:`ROUNDS` keys.

    A Feistel network over pairs (l, r) with l under a = ceil(sqrt(n)) and r under b = ceil(n / a): rounds add a keyed
    function of one side to the other, modulo its size. Pairs are numbered l * b + r; fewer than a of them lie beyond n, and an image
    there goes through the network again until it is inside, so that the map is one to one for every n.
    """
    df = df.withColumn("_a", F.expr(f"cast(ceil(sqrt({n})) as long)")).withColumn("_b", F.expr(f"({n} + _a - 1) div _a"))
    df = df.withColumn("_l", F.expr(f"{x} div _b")).withColumn("_r", F.expr(f"{x} % _b"))
    for k in range(ROUNDS):
        one, other, size = ("_l", "_r", "_a") if k % 2 == 0 else ("_r", "_l", "_b")
        df = df.withColumn(one, F.expr(f"({one} + {_round(other, f'{keys}[{k}]')}) % {size}"))
    df = df.withColumn("_y", F.expr("_l * _b + _r"))
    # the rare way back inside: sides change places each round, so that one step serves them all, and after an even number of rounds are back in place
    turn = f"named_struct('l', s.r, 'r', (s.l + {_round('s.r', 'key')}) % s.a, 'a', s.b, 'b', s.a)"
    again = f"aggregate({keys}, named_struct('l', v div _b, 'r', v % _b, 'a', _a, 'b', _b), (s, key) -> {turn}, s -> s.l * _b + s.r)"
    return df.withColumn(out, F.expr(f"if(_y < {n}, _y, aggregate(sequence(1L, _a), _y, (v, i) -> if(v < {n}, v, {again})))")).drop("_a", "_b", "_l", "_r", "_y")


def _keys(*parts: Column) -> Column:
    return F.array(*[_hash(*parts, F.lit(k)) for k in range(ROUNDS)])


def slots(per_source: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """``no_src, src, shard, slot, pass, block``: the filled slots of all shards.

    ``per_source``: ``no_src, src, blocks, slots`` (wanted of the source), ``start`` (slots of the sources before it) and
    ``all_slots``. Rows stand for chunks of slots until they have been dealt to as many tasks as the slots need, so a hot source is no task's alone.
    """
    key = ["no_src", "src"]
    total = per_source.agg(F.max("all_slots")).first()[0] or 0
    a_pass = per_source.filter("slots > 0").withColumn("pass", F.explode(F.expr("sequence(0L, (slots - 1) div blocks)")))
    a_pass = a_pass.withColumn("lo", F.col("pass") * F.col("blocks")).withColumn("hi", F.least("slots", F.col("lo") + F.col("blocks")))
    chunks = a_pass
    for step in (CHUNK * CHUNK, CHUNK):
        chunks = chunks.withColumn("lo", F.explode(F.expr(f"sequence(lo, hi - 1, {step}L)"))).withColumn("hi", F.least("hi", F.col("lo") + step))
    chunks = chunks.withColumn("keys", _keys(F.lit("block"), F.lit(seed), *map(F.col, key), F.col("pass"))).withColumn("shard_keys", _keys(F.lit("shard"), F.lit(seed)))
    dealt = chunks.repartition(max(1, -(-total // TASK_SLOTS)), *key, "lo")
    each = dealt.withColumn("j", F.explode(F.expr("sequence(lo, hi - 1)"))).withColumn("at", F.col("start") + F.col("j")).withColumn("j", F.col("j") - F.col("pass") * F.col("blocks"))
    each = permuted(permuted(each, "at", "all_slots", "shard_keys", "slot"), "j", "blocks", "keys", "block")
    return each.select(*key, F.expr(f"slot div {shard_slots}").alias("shard"), "slot", F.col("pass").cast("int").alias("pass"), "block")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 64, shard_slots: int = 8192, lanes: int = 1024, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix and the documents' places: (slots joined with pieces of documents, one row for each document).

    1. A source's documents, ordered by a hash lane and the id, form one stream of words, cut into blocks of ``block``
       words; only the last block of a stream is shorter. Places in the stream are prefix sums: over ``lanes`` lanes a
       source, then inside a lane, so no task orders a whole source, however hot.
    2. A source wants as many slots as its target has of its blocks, to the nearest one. All slots of the mix are dealt
       to output shards of ``shard_slots`` slots by a keyed permutation of their numbers. So a shard's source
       counts are a multinomial draw with the targets' shares, on condition that the shards together hold what each source
       wants (a multivariate hypergeometric draw: variance n p (1 - p) times (N - n) / (N - 1)); sums of free multinomial draws would miss the
       targets of small sources. Its numbers are hashes, so reruns agree.
    3. A source's slot j is pass j div blocks, and there block number perm(j mod blocks), with a keyed permutation of its
       own for each source and pass (:func:`permuted`): in each pass a block is used once at most. At most
       ``cap`` passes are wanted, so no document exceeds ``cap`` times its size, rounded up to whole passes of its blocks.
    4. Slots meet the pieces of documents by (source, block index): an equi-join that spreads a hot source's blocks.

    Mix rows: ``shard, slot, pass, no_src, src, block, k, dup, size, lo, hi`` (words lo to hi of the document with key k, which has ``size`` of them).
    Document rows: ``doc_id, k, dup, size, source_size, target``. ``dup`` tells repeated rows apart.
    Null text: size 0, takes no part but is listed. A null source is a source of its own. Null ids are ordinary
    values. Very long texts are many pieces. All sizes 0, or an empty table: nothing is mixed. A source's taken words are within a block or so of its target, which
    is coarse for one of few words. Other columns are ignored. Sources are a small table: windows over one row a source.
    """
    key = ["no_src", "src"]
    rows = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("no_src"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.pmod(_hash(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))), F.lit(lanes)).cast("int").alias("lane"),
            _row_key(id_col, text_col, source_col).alias("k"),
        ),
        "mix",
    )
    per_lane = rows.groupBy(*key, "lane").agg(F.sum("size").alias("n"))
    per_source = targets(per_lane.groupBy(*key).agg(F.sum("n").alias("source_size")), weights, share, cap)
    per_source = per_source.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    per_source = per_source.withColumn("slots", F.when(F.col("source_size") > 0, F.least(wanted, F.floor(F.col("blocks") * F.lit(float(cap))).cast("long"))).otherwise(F.lit(0)))
    everywhere = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("slots").over(everywhere.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_source = saved(per_source.withColumn("start", before).withColumn("all_slots", F.sum("slots").over(everywhere)), "sources")  # one row a source

    before = W.partitionBy(*key).orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    lane_at = per_lane.select(*key, "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_at")).join(per_source.select(*key, "source_size", "target"), key)
    in_lane = W.partitionBy(*key, "lane").orderBy("doc_id", "k", "size")
    placed = (
        rows.join(lane_at, [*key, "lane"])
        .withColumn("pos", F.col("lane_at") + F.coalesce(F.sum("size").over(in_lane.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("dup", F.row_number().over(W.partitionBy(*key, "lane", "k").orderBy("pos")))
    )
    placed = saved(placed.drop("lane", "lane_at"), "places", rows.count())
    pieces = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(pos div {block}, (pos + size - 1) div {block})")))
        .select(*key, "block", "k", "dup", "size", F.greatest(F.lit(0).cast("long"), F.expr(f"block * {block} - pos")).alias("lo"), F.expr(f"least(size, (block + 1) * {block} - pos)").alias("hi"))
    )
    return slots(per_source, seed, shard_slots).join(pieces.hint("merge"), [*key, "block"]), placed  # slots are far more than the size of the table they come from tells


def taken_words(docs: DataFrame, **options: object) -> DataFrame:
    """One row for each document of :func:`mixture`: its size, source's size and target, and the words the mix takes of it."""
    mix, placed = mixture(docs, **options)
    taken = mix.groupBy("k", "dup").agg(F.sum(F.col("hi") - F.col("lo")).alias("got"))
    return placed.join(taken, ["k", "dup"], "left").select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix as documents: for each document and pass, a row with the columns of ``docs`` and the words taken.

    A document that a pass takes whole keeps its text as it is; one taken in part has the taken words in order,
    joined by blanks. A column ``n_chars``, if there is one, follows the new text. Documents of which nothing is
    taken are not in the mix. The text is shuffled by its key; rows that are repeated (same id, source and text) are
    told apart by a number and joined by that, too, so that no row gathers them. Nulls, ties and clashing columns as in :func:`mixture`.
    """
    mix, placed = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    names = docs.columns
    whole = F.sum(F.col("hi") - F.col("lo")) == F.max("size")
    runs = mix.groupBy("k", "dup", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"), whole.alias("whole"))  # a document's own blocks
    passes = runs.groupBy("k", "dup").agg(F.collect_list(F.struct("pass", "runs", "whole")).alias("passes"))  # at most cap of them
    passes = saved(passes, "passes")  # read twice below
    repeated = placed.filter("dup > 1").select("k").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), _row_key(id_col, text_col, source_col).alias("k"))
    once = whole.join(repeated, "k", "left_anti").join(passes.drop("dup"), "k")
    nth = F.row_number().over(W.partitionBy("k").orderBy(F.to_json("doc")))  # such rows are alike in id, source and text
    again = whole.join(repeated, "k", "left_semi").withColumn("dup", nth).join(passes, ["k", "dup"]).drop("dup")
    got = once.unionByName(again).select("doc", F.explode("passes").alias("one"))
    text = F.col("doc").getField(text_col)
    cut = lambda words: F.array_join(F.flatten(F.transform("one.runs", lambda r: F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    # the words are an argument of a lambda, so that they are looked for once; a column of them would be put into the inner lambda, and all be found again for each run
    part = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), cut), F.lit(0))
    got = got.withColumn("new_text", F.when(F.col("one.whole"), text).otherwise(part))
    return got.select(*[F.col("new_text").alias(c) if c == text_col else F.char_length("new_text").cast("long").alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in names])
