import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from axonframe.llm.packing import Encoder, Windows, pack, pack_items

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed_by_definition(levels, size, s, room):
    """The level with the smallest sum of squares, by computing all sums; an item is cut only where it fits nowhere."""
    best = None
    for cuts in (False, True):
        for h in range(size - 1, -1, -1):
            if (h + s > size) != cuts or (not levels[h] if h else not room):
                continue
            after = levels.copy()
            after[h] -= bool(h)
            after[h + s - size if cuts else h + s] += cuts or h + s < size
            total = int((after[1:size] ** 2).sum())
            if best is None or total < best[0]:
                best = (total, h)
        if best:
            return best[1]


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_sum_of_squares_rule(most):
    rng = random.Random(1)
    w = Windows(20, most)
    cut = lambda x, k: ((x[0], x[1], k), (x[0], x[1] + k, x[2] - k))
    cuts = 0
    for k in range(600):
        s = rng.randint(1, 19)
        before = w.levels.copy()
        h = placed_by_definition(before, 20, s, before.sum() < most)
        full = w.put((k, 0, s), s, cut)
        before[h] -= bool(h)
        before[(h + s) % 20] += h + s != 20
        assert (before == w.levels).all()
        assert (full is not None) == (h + s >= 20)
        assert w.levels.sum() == w.open <= most
        cuts += h + s > 20
        assert full is None or sum(m for _, m in full) == 20
    assert (cuts > 0) == (most < 1000)


@pytest.mark.parametrize("seed", range(12))
def test_pieces(seed):
    rng = random.Random(seed)
    items = [((k, 0, n), n) for k in range(rng.randint(0, 300)) for n in [rng.choice([1, 2, 16, rng.randint(1, 100)])]]
    got, odd, moved, total = defaultdict(list), [], [], sum(n for _, n in items)
    most = rng.choice([1, 3, 64])
    for seq in pack_items(iter(items), 16, most=most, moved=moved):
        n = sum(m for _, m in seq)
        assert n == 16 or n & (n - 1) == 0
        odd += [n] if n < 16 else []
        for (i, at, length), m in seq:
            assert length == m
            got[i].append((at, m))
    assert sum(odd) == total % 16 and moved[0] < most * 16
    for (i, _, n), _ in items:
        at = 0
        for start, m in sorted(got[i]):
            assert start == at and m > 0
            at += m
        assert at == n


@pytest.mark.parametrize(("docs", "share"), [(300, 0.15), (1600, 0.05), (8000, 0.01)])
def test_the_rule_places_nearly_all_tokens(docs, share):
    rng = random.Random(docs)
    sizes = [max(1, int(rng.lognormvariate(5.6, 1.0))) for _ in range(docs)]
    moved = []
    n = sum(1 for _ in pack_items((((k, 0, s), s) for k, s in enumerate(sizes)), 2048, moved=moved))
    assert n <= -(-sum(sizes) // 2048) + 11
    assert moved[0] <= share * sum(s % 2048 for s in sizes)


def test_ids_of_both_libraries():
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.fast is not None
    rng = random.Random(0)
    chars = "abc XYZ\n\t'12é中\U0001f600-_.,!\u200d\u0301\u00a0ß"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a<|endoftext|>b", " " * 5000, "x" * 3000, "it's we'll I'M"]
    for x in texts:
        assert e(x) == t.encode(x, add_special_tokens=False).ids


def test_libraries_that_disagree():
    e, t = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"text {k}" for k in range(120)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.run(texts) == want and e.fast is not None

    class Off:
        def encode_ordinary(self, text):
            return [7]

    e.fast = Off()
    assert e.run(texts) == want and e.fast is None


def check(rows, texts):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = used = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        used += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * used


def test_query(spark, sf):
    from axonframe.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries()["op5_sum_of_squares_packing"](spark, sf).collect(), texts)


def test_odd_rows(odd_docs, no_docs):
    once = odd_docs.dropDuplicates(["doc_id"])
    check(pack(once, PATH).collect(), {r.doc_id: r.text for r in once.collect()})
    twice = pack(odd_docs.filter("doc_id = 1"), PATH).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    for k in (0, 1):  # each of the repeated rows on its own
        assert sorted((r.start, r.length) for r in twice)[k][0] == 0
    assert pack(no_docs, PATH).count() == 0
