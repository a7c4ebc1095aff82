import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from axonframe.llm import mixing
from axonframe.llm.mixing import PRIME, mixed_documents, mixture, permuted, slots, taken_words, targets


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Water filling round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 3000, "d": 0, None: 7}, {"a": 0}, {"z": 10, "é": 20, "Z": 5}, {f"s{k}": (k * 37) % 101 for k in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_src boolean, src string, source_size long")
    got = {None if r.no_src else r.src: r.target for r in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("options", [{}, {"block": 7, "shard_slots": 50, "lanes": 3}])
def test_laws(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = taken_words(docs, **options).join(docs.select("doc_id", "text", "source"), "doc_id").collect()
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    again = {(r.doc_id, r.taken) for r in taken_words(docs.repartition(5), **options).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def network(x, n, keys):
    """The permutation by its definition, in integers."""
    a = next(k for k in range(1, n + 1) if k * k >= n)
    b = -(-n // a)
    y = x
    while True:
        left, right = divmod(y, b)
        for k, key in enumerate(keys):
            other = right if k % 2 == 0 else left
            z = (other + key) % PRIME
            f = (z**3 + key // PRIME) % PRIME
            if k % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        y = left * b + right
        if y < n:
            return y


def test_permutations(spark):
    rng = random.Random(5)
    sizes = [*range(1, 60), 997, 1000, 1024]
    keys = {n: [rng.randrange(1 << 52) for _ in range(4)] for n in sizes}
    df = spark.createDataFrame([(x, n, keys[n]) for n in sizes for x in range(n)], "x long, n long, keys array<long>")
    got = defaultdict(dict)
    for r in permuted(df, "x", "n", "keys", "y").collect():
        got[r.n][r.x] = r.y
    for n in sizes:
        assert sorted(got[n].values()) == list(range(n))
        assert all(got[n][x] == network(x, n, keys[n]) for x in range(0, n, 1 + n // 50))
    steps = [(got[1000][x + 1] - got[1000][x]) % 1000 for x in range(999)]
    assert len(set(steps)) > 500  # no fixed stride


def plan(spark, blocks, wanted):
    starts = [sum(wanted[:k]) for k in range(len(wanted))]
    return spark.createDataFrame([(False, f"s{k}", b, w, s, sum(wanted)) for k, (b, w, s) in enumerate(zip(blocks, wanted, starts, strict=True))], "no_src boolean, src string, blocks long, slots long, start long, all_slots long")


def test_counts_of_shards_vary_as_a_multinomial_draw(spark):
    wanted, n = [3000, 1500, 400, 100], 100
    total = sum(wanted)
    squares = defaultdict(float)
    for seed in range(6):
        rows = slots(plan(spark, [2000, 1500, 399, 50], wanted), seed, n).collect()
        assert sorted(r.slot for r in rows) == list(range(total))
        got = Counter((r.src, r.shard) for r in rows)
        for k, w in enumerate(wanted):
            assert sum(got[f"s{k}", s] for s in range(total // n)) == w
            squares[k] += sum((got[f"s{k}", s] - n * w / total) ** 2 for s in range(total // n))
    for k, w in enumerate(wanted):
        p = w / total
        want = n * p * (1 - p) * (total - n) / (total - 1)
        assert 0.75 <= squares[k] / (6 * total / n) / want <= 1.3


def test_each_source_and_pass_has_its_own_order(spark):
    rows = slots(plan(spark, [500, 500], [1000, 1000]), 7, 64).collect()
    order = {(s, p): [r.block for r in sorted(rows, key=lambda r: r.slot) if (r.src, r["pass"]) == (s, p)] for s in ("s0", "s1") for p in (0, 1)}
    assert all(sorted(o) == list(range(500)) for o in order.values())
    assert len({tuple(o) for o in order.values()}) == 4


def test_a_hot_source_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 100)
    got = slots(plan(spark, [3000, 10], [5000, 10]), 7, 64)
    assert sorted(r.slot for r in got.collect()) == list(range(5010))
    tasks = Counter(r.t for r in got.select(F.spark_partition_id().alias("t")).collect())
    assert len(tasks) > 30 and max(tasks.values()) < 500


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(1, "one two three four " * 9, "a", k) for k in range(40)] + [(2, "five six seven " * 30, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    taken = Counter()
    for r in taken_words(docs).collect():
        taken[r.doc_id] += r.taken
    once = sorted(map(tuple, mixed_documents(docs).collect()))
    got = Counter()
    for r in once:
        got[r[0]] += len(r[1].split())
    assert got == taken
    assert once == sorted(map(tuple, mixed_documents(docs.repartition(7)).collect()))


def test_each_pass_uses_a_block_once(spark, sf):
    mix, _ = mixture(spark.read.parquet(f"{sf}/documents.parquet"), block=32)
    rows = mix.collect()
    assert len({(r.no_src, r.src, r["pass"], r.block, r.k, r.dup) for r in rows}) == len(rows)
    assert {r["pass"] for r in rows} == {0, 1}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = taken_words(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert taken_words(no_docs).count() == 0
    assert taken_words(odd_docs.filter("doc_id = 3")).collect()[0].asDict() == {"doc_id": 3, "size": 0, "source_size": 0, "target": 0.0, "taken": 0}
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").split())
    taken = defaultdict(int)
    for r in rows:
        taken[r.doc_id] += r.taken
    assert all(words[i] == taken[i] for i in taken)
    assert mixed_documents(no_docs).count() == 0


def test_native(spark, sf):
    plan = taken_words(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_are_looked_for_once_a_text(spark, sf):
    """Not once for each run of words that is taken, which would be the square of a long text: 625 runs of 40,000 words here."""
    long = " \t".join(f"w{k}" for k in range(40_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, "one two three " * 9000, "a"), (3, "four five", "b")], "doc_id long, text string, source string")
    got = mixed_documents(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    for at in (m.end() for m in re.finditer(r"lambdafunction\(", plan)):
        depth = 1
        end = next(k for k in range(at, len(plan)) if not (depth := depth + {"(": 1, ")": -1}.get(plan[k], 0)))
        assert "regexp" not in plan[at:end]
    rows = [r for r in got.collect() if r.doc_id == 1]
    assert rows
    for words in (r.text.split() for r in rows):
        assert [int(w[1:]) for w in words] == sorted({int(w[1:]) for w in words})  # in order, none twice
    mix, _ = mixture(docs)
    assert sorted(len(r.text.split()) for r in rows) == sorted(r.n for r in mix.filter("size = 40000").groupBy("k", "pass").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect())
    assert any(r.text == long for r in rows) == any(len(r.text.split()) == 40_000 for r in rows)
