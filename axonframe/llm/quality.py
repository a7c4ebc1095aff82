"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._common import dropped, maybe_among, saved

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Hashes(dict):
    """64-bit hashes of tokens, remembered; forgotten when there are too many."""

    MOST = 100_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[token] = xxh3_64_intdigest(token)
        return h


def features(text: str, hashes: Hashes, bits: int) -> np.ndarray:
    """Buckets of all words and pairs of neighbouring words; runs of signs are words too, case counts by a mark."""
    tokens = TOKEN.findall(text)
    # a word in capitals is its lower-case form with a mark, so that style shows without doubling the vocabulary
    shout = sum(t.isupper() and len(t) > 1 for t in tokens)
    h = np.fromiter((hashes[t.lower()] for t in tokens), dtype=np.uint64, count=len(tokens))
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _MIX[0] + h[1:]) * _MIX[1]
    mark = np.full(shout, hashes["\x00upper"], dtype=np.uint64)
    return (np.concatenate([h * _MIX[1], pairs, mark]) >> np.uint64(64 - bits)).astype(np.int64)


def counts_of(texts: DataFrame, bits: int) -> np.ndarray:
    """Bucket counts over a column of texts: one array of fixed length a task comes to the driver by a sum in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = Hashes(), np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                if t := text.as_py():
                    np.add.at(n, features(t, hashes, bits), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    got = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[got.bucket] = got.n
    return out


def log_weight(spark: SparkSession, ratio: np.ndarray, length: int, half: int, text_col: str = "text") -> Column:
    """log p(target) - log p(raw) of ``length`` n-grams like the text's; only the text goes to Python.

    The sum over a text's n-grams grows with its length, so that short junk lies as near to 0 as short good text. So it is
    the mean over them, shrunk as by ``half`` more n-grams of ratio 1, that counts, times ``length``. 0 without any n-gram.
    """
    bits = len(ratio).bit_length() - 1
    sent = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, r = Hashes(), sent.value
        weight = lambda f: float(r[f].sum() * length / (len(f) + half))
        for texts in batches:
            yield pa.array([weight(features(t, hashes, bits)) if (t := x.as_py()) else 0.0 for x in texts], pa.float64())

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(F.col(text_col).cast("string"))


def own_off_weight(spark: SparkSession, target: np.ndarray, raw: np.ndarray, prior: float, length: int, half: int, text_col: str) -> Column:
    """The :func:`log_weight` of a text that is among those counted in ``target``, as if it weren't: its own n-grams are taken off."""
    bits, (all_target, all_raw) = len(target).bit_length() - 1, (target.sum(), raw.sum())
    sent = spark.sparkContext.broadcast((target, raw))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, (target, raw) = Hashes(), sent.value

        def weight(f: np.ndarray) -> float:
            u, n = np.unique(f, return_counts=True)
            ratio = np.log(target[u] - n + prior) - np.log(raw[u] * ((all_target - len(f)) / all_raw) + prior)
            return float((n * ratio).sum() * length / (len(f) + half))

        for texts in batches:
            yield pa.array([weight(features(t, hashes, bits)) if (t := x.as_py()) else 0.0 for x in texts], pa.float64())

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(F.col(text_col))


def kth_largest(rows: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, exactly: counts in ever finer bins, one small aggregation a pass.

    Only bin counts come to the driver. k of 0 or less: above every value; k of the row count or more: the smallest.
    """
    lo, hi, n = rows.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return lo
    above = 0  # rows over hi
    while lo < hi:
        width = (hi - lo) / bins
        inside = rows.filter((F.col(col) >= lo) & (F.col(col) <= hi))
        at = F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / width)).cast("int") if width > 0 else F.lit(0)
        got = sorted(inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda r: -r.lo)
        for r in got:
            if above + r.n >= k:
                if (r.lo, r.hi) == (lo, hi):  # too close to be told apart
                    return lo
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo


def decided(docs: DataFrame, labels: DataFrame, k: int | None = None, carry: list[str] | None = None, sample_docs: int | None = None, bits: int = 16, prior: float = 10.0, length: int = 100, half: int = 20, lose: float = 0.002, slack: float = 1.5, seed: int = 11, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` (only those in ``carry``, if given, and the id) as ``c0, c1, ...``, with ``log_weight``, ``gumbel_key`` and ``kept``, the sample drawn by importance resampling.

    The target model counts the n-grams of all documents labelled good (quality 1 and not toxic; a document with several
    labels is good if all are), or of ``sample_docs`` of them by a hash of the id, if given. Labels meet texts by a join on the id; no ids come to the driver.
    The raw model counts all documents. Buckets that are seldom seen are drawn to ratio 1 by ``prior`` counts. A document's
    log weight (:func:`log_weight`) plus Gumbel noise (from a hash of the id) is its key, and the ``k`` largest keys are a
    sample without replacement by weight.

    ``k`` is a parameter. Left out, it is the number of documents that look like the target: of at least the log weight that tells
    how far good documents fall (from their median, ``slack`` times the way to their ``lose`` quantile). ``whole``: all good documents are counted,
    and all tell how far they fall, each judged without its own n-grams. Otherwise a fifth of them isn't counted and tells it.
    Rows with equal keys at the threshold are all kept. No labels, or none of them good: nothing to tell apart, all are kept.
    A toxic document in good language has the n-grams of the target but for a few words, and is not told apart by them.

    Null or empty text: log weight 0. Null ids take part with one common noise. Repeated rows get equal keys. Very long texts count whole. An
    empty table gives no rows. Other columns are carried through, whatever they are called. Two passes over the text, and a shuffle of the good documents' texts
    and few others (:func:`maybe_among`) to meet the labels.
    """
    names = docs.columns
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0")
    spark, order = docs.sparkSession, (F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    good = good.select("doc_id")
    if sample_docs is not None:
        good = good.orderBy(*order).limit(sample_docs)
    good = ids = saved(good, "good-ids")
    fifth = 0 if whole else good.count() // 5
    good = good.withColumn("check", F.lit(False)) if not fifth else good.join(good.orderBy(*order).limit(fifth).withColumn("check", F.lit(True)), "doc_id", "left").fillna(False, "check")
    near = maybe_among(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), ids, "doc_id", ids.count())
    texts = saved(near.join(good.hint("merge"), "doc_id").select("text", "check"), "good")  # the same join at every size
    dropped(ids)
    raw = counts_of(docs.select(F.col(text_col).cast("string")), bits)
    target = counts_of(texts.filter("not check").select("text"), bits)
    if target.sum():
        ratio = np.log(target + prior) - np.log(raw * (target.sum() / raw.sum()) + prior)  # a bucket's prior is the raw model's share
    else:
        ratio = np.zeros(1 << bits)
    got = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    got = got.withColumn("log_weight", log_weight(docs.sparkSession, ratio, length, half, f"c{names.index(text_col)}"))
    at = f"c{names.index(id_col)}"
    got = got.select(*[f"c{k}" for k, c in enumerate(names) if carry is None or c in carry or c == id_col], "log_weight")
    u = (F.pmod(F.xxhash64(at, F.lit(seed + 1)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    got = saved(got.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    if k is not None:
        edge = kth_largest(got, "gumbel_key", k)
    elif target.sum():
        of = own_off_weight(spark, target, raw, prior, length, half, "text") if whole else log_weight(spark, ratio, length, half)
        weights = saved((texts.filter("check") if fifth else texts).select(of.alias("log_weight")), "good-weights")
        n = weights.count()
        low, mid = (kth_largest(weights, "log_weight", max(1, j)) for j in (n - int(lose * n), n // 2))
        floor = mid - slack * (mid - low) if n else float("inf")
        edge = kth_largest(got, "gumbel_key", got.filter(F.col("log_weight") >= floor).count())
        dropped(weights)
    else:
        edge = float("-inf")
    dropped(texts)
    return got.withColumn("kept", F.col("gumbel_key") >= edge)


def resample(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """:func:`decided` under the names of ``docs``; a column of ``docs`` that is called like one of the results gives way to it."""
    new = ["log_weight", "gumbel_key", "kept"]
    got = decided(docs, labels, **options)
    return got.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in new and f"c{k}" in got.columns], *new)
