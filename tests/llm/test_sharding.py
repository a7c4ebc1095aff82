import random
import zlib
from collections import Counter, defaultdict

import pytest

from axonframe.llm.sharding import longest_first, shard_longest_first


def check(rows, texts, shards=16):
    assert len(rows) == len(texts)
    of_text, slots, load = {}, defaultdict(list), defaultdict(int)
    by_id = defaultdict(list)
    for i, t in texts:
        by_id[i].append(t or "")
    for r in rows:
        t = next(t for t in by_id[r.doc_id] if len(t.encode()) + 1 == r.size and zlib.crc32(t.encode()) == r.text_crc32)
        assert of_text.setdefault(t, r.shard) == r.shard
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def one_by_one(sizes, shards):
    """Each unit to the least-loaded shard, the largest first: loads, and the sizes that each shard got."""
    load, got = [0] * shards, [[] for _ in range(shards)]
    for size in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda k: (load[k], k))
        load[s] += size
        got[s].append(size)
    return load, [Counter(g) for g in got]


@pytest.mark.parametrize("seed", range(6))
def test_runs_as_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 400)]) for _ in range(rng.choice([0, 5, 300, 3000]))]
    runs = sorted(Counter(sizes).items(), reverse=True)
    shards = rng.choice([1, 3, 16])
    _, want = one_by_one(sizes, shards)
    got = longest_first(runs, shards)
    assert [Counter({size: n[s] for (size, _), n in zip(runs, got, strict=True) if n[s]}) for s in range(shards)] == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = check(shard_longest_first(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    groups = Counter()
    for r in docs.collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    want, _ = one_by_one(groups.values(), 16)
    assert [load[s] for s in range(16)] == want
    assert max(want) <= 1.01 * sum(want) / 16


def test_long_plans_are_joined(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, shard_longest_first(docs).collect()), key=str)
    assert sorted(map(tuple, shard_longest_first(docs, most_sent=0, hot=20).collect()), key=str) == want


def test_hot_group_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}") for k in range(600)]
    check(shard_longest_first(spark.createDataFrame(rows, "doc_id long, text string"), lanes=5).collect(), rows)
    check(shard_longest_first(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert shard_longest_first(no_docs).count() == 0
    a = sorted(map(tuple, shard_longest_first(odd_docs).collect()), key=str)
    assert a == sorted(map(tuple, shard_longest_first(odd_docs.repartition(3)).collect()), key=str)
