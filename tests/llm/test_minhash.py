import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from axonframe.llm import _common
from axonframe.llm.minhash import Scheme, duplicate_groups, likely, near_duplicates, shingles


def sets(texts, size):
    out = {}
    for i, t in texts:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def brute(texts, size, percent=80):
    s = sets(texts, size)
    label = {i: i for i in s}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    change = True
    while change:
        change = False
        for a, b in links:
            low = min(label[a], label[b])
            change |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s[i]), label[i]) for i in s}


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(30, 200))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
        texts.append(passage + [word() for _ in range(rng.randint(5, 40))])
    rng.shuffle(texts)
    return [(k * 3 + 1, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "chunk"), [(4, 2048), (5, 8)])
def test_against_brute_force(spark, size, chunk):
    texts = corpus()
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=size, chunk=chunk).collect()
    want = brute(texts, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_copies_that_meet_only_through_their_base(spark):
    """Each copy is like the base, but hardly one copy like another: stars from random hubs don't do."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    texts = [(500, " ".join(base))]
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(0, 300, 6), 8):
            copy[at] = f"x{k}_{at}"
        texts.append((k, " ".join(copy)))
    want = brute(texts, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4, chunk=16).collect()}
    assert got == want


def test_shingles():
    assert len(shingles(None, 4)) == len(shingles(b" \t\n", 4)) == 0
    assert len(shingles(b"a b", 4)) == 1
    assert np.array_equal(shingles(b"A  b\x0bC d", 4), shingles(b"a b c D", 4))
    assert not np.array_equal(shingles("É b c d".encode(), 4), shingles("é b c d".encode(), 4))
    assert len({shingles(x, 4)[0] for x in (b"a", b"a a", b"a a a", b"a a a a")}) == 4


def test_pruning_keeps_links():
    scheme = Scheme()
    least = scheme.least_matches(80, 1e-6)
    assert least == sorted(least) and least[-1] < 0.8 * scheme.k
    rng = np.random.default_rng(2)
    a = rng.integers(0, 60000, (4000, scheme.k)).astype("<u2")
    for s, lowest, highest in ((0.85, 0.995, 1), (0.4, 0, 0.01)):
        b = np.where(rng.random(a.shape) < s, a, a + 1)
        assert lowest <= len(likely(a, b, least, scheme.batch)[0]) / len(a) <= highest


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3, 4, None)} == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True)}
    assert near_duplicates(no_docs).count() == 0


def test_repeated_ids(spark):
    """Documents of one id with different texts are documents of their own."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    a, b, c = ([word() for _ in range(80)] for _ in range(3))
    near = lambda x: " ".join([*x[:-1], word()])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, near(c)), (9, near(c)), (9, " ".join(a)), (0, ""), (0, near(c)), (9, None)]
    want = [1, 1, 1, 1, 1, 0, 0, 1, 0, 0, 9]
    for ids in (rows, [(i + (1 << 62), t) for i, t in rows]):
        df = spark.createDataFrame(ids, "doc_id long, text string")
        got = duplicate_groups(df)
        rows_ = sorted((r.id, r.n, r.component) for r in got.collect())
        shift = ids[0][0] - 1
        assert sorted((i, c) for i, _, c in rows_) == sorted((i, w + shift) for (i, _), w in zip(ids, want, strict=True))
        assert len({r.group for r in got.collect() if r.group is not None}) == 3
        assert all(r.kept == (r.doc_id == r.component_id) for r in near_duplicates(df).collect())


def test_hot_keys_are_dealt(spark, monkeypatch):
    """As without: copies, near copies and hubs of many rows, each dealt to several tasks."""
    monkeypatch.setattr(_common.hot_keys, "__defaults__", (3, 1 << 40))
    texts = corpus(4, 15) + [(100_000 + k, "one text that many rows share word by word") for k in range(40)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 4)


def test_salted_join(spark):
    rows = spark.range(1000).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("x"))
    keyed = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (5, "d")], "k long, v string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    got = _common.salted_join(rows, keyed, ["k"], _common.hot_keys(counts, ["k"], 1000, least=50, most=100))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keyed, "k").collect()))


def test_query_against_brute_force(spark, sf):
    from axonframe.llm.queries import queries

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op8_minhash_bayes"](spark, sf).collect()}
    assert got == brute(texts, 4)
