import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from axonframe.llm import quality
from axonframe.llm._common import maybe_among
from axonframe.llm.quality import Hashes, features, kth_largest, resample


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(size=500)] + [0.25] * 40
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 7, 250, 300, 540):
        assert kth_largest(df, "x", k, bins=16) == sorted(x, reverse=True)[k - 1]
    assert kth_largest(df, "x", 0) == float("inf")
    assert kth_largest(df.filter("false"), "x", 3) == float("inf")


def plain_buckets(text, bits):
    """Buckets of words and pairs of neighbours, in plain integers."""
    tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")
    h = [xxhash.xxh3_64_intdigest(t.lower()) for t in tokens]
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    out = [x * b for x in h] + [(x * a + y) * b for x, y in zip(h, h[1:])]  # noqa: B905
    out += [xxhash.xxh3_64_intdigest("\x00upper") for t in tokens if t.isupper() and len(t) > 1]
    return [x % (1 << 64) >> (64 - bits) for x in out]


def test_weights_against_plain_counts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in resample(docs.select("doc_id", "text"), labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    by_id = defaultdict(list)
    for r in labels.collect():
        by_id[r.doc_id].append(r.quality == 1 and not r.toxic)
    good = spark.createDataFrame([(i,) for i, g in by_id.items() if all(g)], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    ids = [r.doc_id for r in good.collect()]
    fit, check = ids[len(ids) // 5 :], ids[: len(ids) // 5]
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(plain_buckets(t, 16))
        if i in fit:
            target.update(plain_buckets(t, 16))
    share = sum(target.values()) / sum(raw.values())
    weight = {}
    for i, t in texts.items():
        b = plain_buckets(t, 16)
        weight[i] = 100 * sum(math.log(target[x] + 10) - math.log(raw[x] * share + 10) for x in b) / (len(b) + 20)
        assert got[i].log_weight == pytest.approx(weight[i], abs=1e-9)
    down = sorted((weight[i] for i in check), reverse=True)
    n = len(down)
    low, mid = down[n - int(0.002 * n) - 1], down[n // 2 - 1]
    k = sum(w >= mid - 1.5 * (mid - low) - 1e-9 for w in weight.values())
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.gumbel_key >= keys[k - 1]}
    again = {r.doc_id: r for r in resample(docs.select("doc_id", "text").repartition(3), labels).collect()}
    assert all(got[i].kept == again[i].kept for i in texts)
    assert sum(r.kept for r in resample(docs, labels, k=50).collect()) == 50


def test_gumbel_noise(spark):
    """Equal weights: any k documents are as likely, and an odd is the ratio of two weights."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    keys = [r.gumbel_key for r in resample(rows, none).collect()]
    assert np.mean(keys) == pytest.approx(0.5772, abs=0.08) and np.var(keys) == pytest.approx(math.pi**2 / 6, rel=0.12)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = resample(docs, labels).join(labels, "doc_id").select("kept", "quality", "toxic", "text").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(good) >= 0.995
    for lo, hi in ((50, 200), (200, 1000), (1000, 10**9)):  # by words; shorter texts say too little
        bad = [r.kept for r in rows if r.quality == 0 and lo <= len((r.text or "").split()) < hi]
        assert len(bad) > 30 and np.mean(bad) <= 0.1


def test_features_are_whole_text():
    h = Hashes()
    long = "word " * 200_000
    assert len(features(long, h, 14)) == 2 * 200_000 - 1
    assert len(features("", h, 14)) == 0


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_odd_rows(request, which, labels):
    docs = request.getfixturevalue(which)
    out = resample(docs, labels)
    assert out.count() == docs.count()
    assert resample(docs, labels.filter("false")).filter("not kept").count() == 0


def test_pipeline_counts_all_good_documents(spark, sf):
    """Against plain counts of all of them; the threshold from all of them, each without its own n-grams."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, by_id = {r.doc_id: r.text for r in docs.collect()}, defaultdict(list)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        by_id[r.doc_id].append(r.quality == 1 and not r.toxic)
    buckets = {i: Counter(plain_buckets(t, 16)) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    good = [i for i in texts if i in by_id and all(by_id[i])]
    for i, b in buckets.items():
        raw.update(b)
        if i in good:
            target.update(b)

    def weight(b, off):
        share = (sum(target.values()) - sum(off.values())) / sum(raw.values())
        return 100 * sum(n * (math.log(target[x] - off[x] + 10) - math.log(raw[x] * share + 10)) for x, n in b.items()) / (sum(b.values()) + 20)

    down = sorted((weight(buckets[i], buckets[i]) for i in good), reverse=True)
    n = len(down)
    low, mid = down[n - int(0.002 * n) - 1], down[n // 2 - 1]
    k = sum(weight(b, Counter()) >= mid - 1.5 * (mid - low) - 1e-9 for b in buckets.values())
    keys = {r.doc_id: weight(buckets[r.doc_id], Counter()) + r.gumbel_key - r.log_weight for r in resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}  # the same noise
    edge = sorted(keys.values(), reverse=True)[k - 1]
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == {i for i, x in keys.items() if x >= edge - 1e-9}


def test_only_texts_of_good_documents_are_shuffled(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.md5(F.col("id").cast("string")), 30)).alias("text"))
    labels = spark.range(0, 4000, 100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen, saved = [], quality.saved

    def spy(df, name, *more):
        if name == "good":
            df.collect()
            todo = [df._jdf.queryExecution().executedPlan()]
            while todo:
                node = todo.pop()
                todo += [node.children().apply(k) for k in range(node.children().size())]
                if node.nodeName() == "Exchange":
                    seen.append(node.metrics().apply("dataSize").value())
        return saved(df, name, *more)

    monkeypatch.setattr(quality, "saved", spy)
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        assert resample(docs, labels).count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and sum(seen) < 0.2 * 4000 * 965


@pytest.mark.parametrize("kind", ["bigint", "int", "string", "double"])
def test_no_key_is_missed(spark, kind):
    rows = spark.range(-3000, 30_000).select(F.col("id").cast(kind).alias("doc_id")).union(spark.sql(f"select cast(null as {kind})"))
    for n, keys in ((0, rows.filter("false")), (1000, rows.filter("doc_id % 33 = 0")), (30_000, rows.filter("doc_id >= 0"))):
        near = maybe_among(rows, keys, "doc_id", n)
        assert near.columns == ["doc_id"] and near.join(keys, "doc_id").count() == keys.count()
        assert kind == "double" or near.count() <= keys.count() + 0.12 * rows.count() + 1
    assert maybe_among(rows, spark.range(5).select(F.col("id").cast("tinyint").alias("doc_id")), "doc_id", 5).count() == rows.count()
