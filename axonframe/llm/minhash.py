"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact check of survivors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._common import components, dropped, hot_keys, salted_join, saved

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words in a UTF-8 text, A-Z lower-cased, words parted by ASCII white space.

    With fewer words, the whole sequence is the only shingle; no words give none.
    """
    words = (text or b"").lower().split()  # on bytes: A-Z; blank, \t, \n, \v, \f, \r
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    s = np.full(len(h) - n + 1, 0 if n == size else n, dtype=np.uint64)
    for j in range(n):
        s = (s + h[j : len(h) - n + 1 + j]) * _ODD[j & 3] + np.uint64(j)
    return np.unique(_mixed(s))


class Scheme:
    """``bands`` bands of ``rows`` minima; ``bands * rows`` hash functions, rounded up to whole batches of ``batch``."""

    def __init__(self, bands: int = 25, rows: int = 5, batch: int = 16, seed: int = 5) -> None:
        self.bands, self.rows, self.batch = bands, rows, batch
        self.k = -(-bands * rows // batch) * batch
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, self.k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.k, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> tuple[bytes, list[int]]:
        """The low 16 bits of each minimum, and a key for each band."""
        low = np.full(self.k, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(s), 2048):
            np.minimum(low, (np.multiply.outer(self.a, s[at : at + 2048]) + self.b[:, None]).min(axis=1), out=low)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD[3]
        for r in range(self.rows):
            key = _mixed(key + low[: self.bands * self.rows].reshape(self.bands, self.rows)[:, r])
        return (low & np.uint64(0xFFFF)).astype("<u2").tobytes(), key.view(np.int64).tolist()

    def least_matches(self, percent: int, miss: float) -> list[int]:
        """For each number of batches compared, the fewest matches with which a pair goes on.

        With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m); a pair is pruned as soon as that falls below ``miss``.
        """
        t = percent / 100
        out = []
        for n in range(self.batch, self.k + 1, self.batch):
            p, m = (1 - t) ** (n + 1), 0
            while p < miss:
                m += 1
                p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return out


def _signatures(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, k)


def likely(a: np.ndarray, b: np.ndarray, least: list[int], batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two aligned signature arrays that no batch prunes, and their matches."""
    at, m = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, need in enumerate(least):
        cut = slice(k * batch, (k + 1) * batch)
        m = m + (a[at, cut] == b[at, cut]).sum(axis=1)
        go = m >= need
        at, m = at[go], m[go]
    return at, m


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(_mixed(s + _ODD[0]).sum(dtype=np.uint64).view(np.int64))


def featured(docs: DataFrame, size: int, scheme: Scheme, id_col: str, text_col: str) -> DataFrame:
    """``id, t, n, h1, h2`` (a hash of the text, the set's size and a 128-bit fingerprint), ``sig`` and ``keys``; one pass over the text, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig, keys = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                p, q = fingerprint(s)
                h1.append(p)
                h2.append(q)
                x = scheme.signature(s) if len(s) else (b"", [])
                sig.append(x[0])
                keys.append(x[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "t", "n", "h1", "h2", "sig", "keys"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("t"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, t long, n long, h1 long, h2 long, sig binary, keys array<long>")


def text_key(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def with_both(pairs: DataFrame, keyed: DataFrame, col: str, hot: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with the column of both ids from ``keyed`` as ``xa`` and ``xb``; pairs of a hub (``hot``: ``id, parts``) are dealt to many tasks."""
    for side in ("a", "b"):
        of = keyed.select(F.col("id").alias(side), F.col(col).alias(f"x{side}"))
        pairs = salted_join(pairs, of, [side], F.broadcast(hot.withColumnRenamed("id", side)), ["a", "b"])
    return pairs


def probable(pairs: DataFrame, sigs: DataFrame, scheme: Scheme, least: list[int], hot: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that survive the comparison of signature batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, _ = likely(_signatures(b.column(2), scheme.k), _signatures(b.column(3), scheme.k), least, scheme.batch)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["a", "b"])

    return with_both(pairs, sigs, "sig", hot).select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def sets_of(ids: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, names: DataFrame | None = None, most_bits: int = 26) -> DataFrame:
    """``id, set`` of the classes whose id is in ``ids`` (and a few others): only their texts reach Python.

    A class's id is that of a document. ``names`` (``id, rep, n, h1, h2``) tells which one's and the set's fingerprint where ids of documents are repeated.
    The ids become a bitmap of at most 2**``most_bits`` bits, whatever their number; it is broadcast as 64-bit words
    (a million at most) and looked up by an equi-join where the documents are read, so other texts are never shuffled.
    """
    reps = ids if names is None else ids.join(names, "id").select(F.col("rep").alias("id")).distinct()
    n = reps.count()
    bits = min(most_bits, max(12, (16 * n).bit_length()))
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = reps.select(spot.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("p", spot).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(words), "word").filter(F.expr("(bits & shiftleft(1L, cast(p % 64 as int))) != 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            marks = [(len(s), *fingerprint(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([m[k] for m in marks], pa.int64()) for k in range(3)], pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "h1", "h2", "set"])

    got = rows.select("id", "text").mapInArrow(run, "rep long, n long, h1 long, h2 long, set binary")
    if names is None:
        return got.select(F.col("rep").alias("id"), "set")
    return got.join(names, ["rep", "n", "h1", "h2"]).select("id", "set").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both(pairs, sets, "set", hot).select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


class _Group:
    """Members of a bucket, or of two of its chunks, in one task."""

    def __init__(self, scheme: Scheme, least: list[int], percent: int) -> None:
        self.scheme, self.least, self.percent = scheme, least, percent

    def survivors(self, part: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, keys: np.ndarray, key: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the later ones (or those of the other chunk) that it may link with: of another component, of
        a size that allows a link, met in no earlier band, and not pruned by the signatures."""
        two = part.min() != part.max()
        every = np.arange(len(part))
        for i in every:
            open_ = (comp != comp[i]) & ((part > part[i]) if two else (every > i))
            open_ &= 100 * np.minimum(n, n[i]) >= self.percent * np.maximum(n, n[i])
            j = np.flatnonzero(open_)
            if not len(j):
                continue
            j = j[keys[i][(keys[j] == keys[i]).argmax(axis=1)] == key]
            ok, _ = likely(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], self.least, self.scheme.batch)
            if len(ok):
                yield i, j[ok]

    def links(self, part: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, keys: np.ndarray, key: int, sets: list) -> list[tuple[int, int]]:
        """Verified links between components, enough of them to join what can be joined."""
        names, at = np.unique(comp, return_inverse=True)
        up = np.arange(len(names))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        out = []
        for i, j in self.survivors(part, comp, n, sig, keys, key):
            mine = root(at[i])
            j = j[np.array([root(at[y]) != mine for y in j])]
            for lo in range(0, len(j), 512):
                some = j[lo : lo + 512]
                both = overlaps(sets[i], [sets[y] for y in some])
                for y in some[100 * both >= self.percent * (n[i] + n[some] - both)]:
                    r, q = root(at[i]), root(at[y])
                    if r != q:
                        up[max(r, q)] = min(r, q)
                        out.append((int(ids[i]), int(ids[y])))
        return out


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others; none is empty."""
    flat = np.concatenate(others)
    spot = np.searchsorted(one, flat)
    spot[spot == len(one)] = 0
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((one[spot] == flat).astype(np.int64), starts)


def settled(members: DataFrame, keyed: DataFrame, sets: DataFrame, scheme: Scheme, least: list[int], percent: int, chunk: int, chunk_shingles: int) -> DataFrame:
    """Verified links ``a, b`` between different components inside buckets.

    ``members``: ``key, id, comp, n`` (the set's size), ``m`` and ``total`` (the bucket's members and their sizes' sum).
    A bucket over ``chunk`` members or ``chunk_shingles`` shingles is cut into chunks, and each pair of chunks is a
    group of its own, so what a task holds is bounded and a hot bucket is spread over many. Pairs live inside the task only: what leaves it
    joins components, at most a link a member.
    """
    g = F.greatest(F.lit(1), F.ceil(F.col("m") / chunk), F.ceil(F.col("total") / chunk_shingles)).cast("int")
    rows = members.withColumn("g", g).withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("id", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("group"), "key", "part", "comp", "n")
    rows = rows.join(keyed, "id").join(sets, "id").select("group", "key", "part", "id", "comp", "n", "sig", "keys", "set").repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(scheme, least, percent)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            _, key, part, ids, comp, n, sig, keys = (np.concatenate([h[k] for h in held]) for k in range(8))
            sets_ = [x for h in held for x in h[8]]
            held.clear()
            out = []
            for k in np.unique(key):  # one, unless hashes of groups collide
                at = np.flatnonzero(key == k)
                out += group.links(part[at], ids[at], comp[at], n[at], sig[at], keys[at], k, [sets_[x] for x in at])
            return pa.RecordBatch.from_arrays([pa.array([min(e) for e in out], pa.int64()), pa.array([max(e) for e in out], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            cols += [_signatures(b.column(6), scheme.k), b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, scheme.bands)]
            sets_ = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in b.column(8)]
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1][0][0] != cols[0][i]:
                    yield flush()
                held.append((*(c[i:j] for c in cols), sets_[i:j]))
        if held:
            yield flush()

    return rows.mapInArrow(run, "a long, b long").distinct()


def duplicate_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, miss: float = 1e-6, chunk: int = 2048, chunk_shingles: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, t, n, group, component`` of each document: ``t`` is its :func:`text_key`, ``n`` the size of its set, ``group`` a number for what
    is linked (null: nothing), ``component`` the smallest id in it.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of word shingles.
    1. One pass over the text gives each document's set size, a 128-bit fingerprint of the set, a MinHash signature and
       a key for each band. Documents with equal sets are one class, which its smallest id stands for from here on (where
       documents of several classes have that same id, the other classes get numbers beyond all ids).
    2. Classes that share a band's key are candidates. A pair with similarity s shares one with probability
       1 - (1 - s^rows)^bands: all but 5 in 100,000 at 0.8 by default.
    3. First each bucket's members against one hub (drawn anew for each bucket), so a large group of copies costs a
       pair a member, not its square. Candidates are compared by batches of the signature and pruned when the posterior
       chance of a link falls below ``miss``; what survives is checked on full sets, and links give components.
    4. Then, in buckets that still span several components, each member against all of the other components, by
       chunks of bounded size: pruned by size and by signature batches, then checked on full sets in the same
       task. Only links that join components leave it. So each candidate pair is either checked, pruned by the
       posterior bound, or inside one component already; there is no cap. Members that are like each other but not
       enough so are compared pair by pair; that is the square of such a bucket, spread over its pairs of chunks.
    Full sets are made anew from the text for the documents in surviving pairs and such buckets only. Joins on classes,
    buckets and hubs deal the rows of hot keys to many tasks. Tables between the steps are in the shared folder.

    Null and empty texts, and those without words: no shingles, linked with nothing. Very long texts count whole. Repeated rows have equal sets, so
    they are one class, each with its row; rows of one id with other texts are documents of their own. A null id is linked with nothing. An empty table gives no rows. Other columns are ignored.
    """
    scheme = Scheme(bands, rows)
    least = scheme.least_matches(percent, miss)
    feats = saved(featured(docs, shingle, scheme, id_col, text_col), "features")
    some = feats.filter("n > 0 and id is not null")
    mark = ["n", "h1", "h2"]
    size, top, bottom = feats.agg(F.count(F.lit(1)), F.max("id"), F.min("id")).first()
    repeated = not some.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    classes = some.groupBy(*mark).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    if repeated:
        first = classes.groupBy("rep").agg(F.min(F.struct(*mark)).alias("first"))
        beyond = F.lit(top + 1) + F.monotonically_increasing_id() if top < 1 << 62 else F.lit(bottom - 1) - F.monotonically_increasing_id()
        classes = classes.join(first, "rep").withColumn("id", F.when(F.col("first") == F.struct(*mark), F.col("rep")).otherwise(beyond)).drop("first")
    else:
        classes = classes.withColumn("id", F.col("rep"))
    classes = saved(classes, "classes", size)
    keyed = some.withColumnRenamed("id", "rep").join(classes.drop("m"), ["rep", *mark])  # by the id, too, so a group of copies isn't one task's
    keyed = saved((keyed.dropDuplicates(["id"]) if repeated else keyed).select("id", "n", "sig", "keys"), "signatures", size)
    names = classes.select("id", "rep", *mark) if repeated else None
    sets = lambda ids: sets_of(ids, docs, shingle, id_col, text_col, names)
    entries = keyed.select("id", "n", F.explode("keys").alias("key"))
    mask = F.xxhash64("key")  # a hub is the member with the smallest masked id: another order in each bucket
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.min(F.col("id").bitwiseXOR(mask)).alias("low")).filter("m > 1")
    buckets = saved(buckets.select("key", "m", "total", F.col("low").bitwiseXOR(mask).alias("hub")), "buckets", size)
    members = saved(salted_join(entries, buckets, ["key"], hot_keys(buckets, ["key"], size * bands), ["id"]), "members", size)
    stars = members.filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    hubs = hot_keys(buckets.groupBy(F.col("hub").alias("id")).agg(F.sum("m").alias("m")), ["id"], size * bands)
    tried = saved(probable(stars, keyed.select("id", "sig"), scheme, least, hubs), "pairs", size)
    links = saved(confirmed(tried, sets(tried.select(F.col("a").alias("id")).union(tried.select("b")).distinct()), percent, hubs), "confirmed", size)
    comp = saved(components(links, size), "components", size)
    labelled = members.filter("m > 2").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("m").alias("m")).filter("lo != hi").select("key", "m")
    open_ = saved(open_, "open", size)
    unsettled = salted_join(labelled.select("key", "id", "n", "m", "total", "comp"), open_.select("key"), ["key"], hot_keys(open_, ["key"], size * bands), ["id"])
    unsettled = saved(unsettled, "unsettled", size)
    if not unsettled.isEmpty():
        more = settled(unsettled, keyed.select("id", "sig", "keys"), sets(unsettled.select("id").distinct()), scheme, least, percent, chunk, chunk_shingles)
        more = saved(more, "confirmed", size)
        before, comp = comp, saved(components(links.union(more), size), "components", size)
        dropped(before, more)
    dropped(keyed, buckets, members, tried, links, open_, unsettled)  # what comes now needs classes and components only
    of_class = classes.join(comp, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    if repeated:  # a number beyond all ids is no document's id
        of_class = of_class.join(of_class.groupBy("group").agg(F.min("rep").alias("component")), "group")
    else:
        of_class = of_class.withColumn("component", F.col("group"))
    in_class = salted_join(some.select("id", "t", *mark), of_class.select(*mark, "group", "component"), mark, hot_keys(classes, mark, size), ["id", "t"]).select("id", "t", "n", "group", "component")
    alone = feats.filter("n = 0 or id is null").select("id", "t", "n", F.lit(None).cast("long").alias("group"), F.col("id").alias("component"))
    out = saved(in_class.union(alone), "groups")
    dropped(feats, classes, comp)
    return out


def near_duplicates(docs: DataFrame, **options: object) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document, by :func:`duplicate_groups`, whose options it takes.

    ``component_id`` is the smallest id reachable by links, and ``kept`` whether it is the document's own. A null id is kept.
    """
    got = duplicate_groups(docs, **options)
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
