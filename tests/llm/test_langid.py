import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonframe.llm.langid import Index, Model, identify, train


def model(langs, rows):
    return Model(langs, pa.Table.from_pylist([dict(zip(("lang", "kind", "item", "n"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())])))


def test_words_first_then_shorter_ngrams():
    m = model(["a", "b"], [("a", 0, "word", 9), ("b", 0, "other", 9), ("a", 4, "<unk", 5), ("b", 1, "z", 3), ("a", 1, "q", 3)])
    assert m.predict("word")[0] == "a"
    assert m.predict("unkn")[0] == "a"  # by a 4-gram
    assert m.predict("zz")[0] == "b"  # by characters
    assert m.predict("123 ...") == ("und", 0.0)
    assert m.predict("½") == ("und", 0.0)
    assert m.predict(None) == ("und", 0.0)
    assert model([], []).predict("word") == ("und", 0.0)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_nothing_learned_from_held_out_rows(spark):
    docs = spark.createDataFrame([(k, "aaa bbb" if zlib.crc32(str(k).encode()) % 3 != 1 else "ccc ddd", "x" if zlib.crc32(str(k).encode()) % 3 != 1 else "y") for k in range(40)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs).collect()} == {"x"}


def test_odd_rows(odd_docs, no_docs):
    rows = identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 6}
    assert identify(no_docs).count() == 0
    assert train(no_docs, F.lit(True)).langs == []


def plain(rows, text):
    """Language and share of the likelihood, from dictionaries of counts over ``rows`` (language, text)."""
    words = lambda t: ["".join(w) for w in re.findall(r"[^\W\d_]+", t.lower())]
    cut = lambda w, n: list(w) if n == 1 else [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]
    langs = sorted({lang for lang, _ in rows})
    counts = defaultdict(Counter)
    for lang, t in rows:
        for w in words(t):
            counts[0][w, lang] += 1
            for n in (4, 3, 2, 1):
                counts[n].update((g, lang) for g in cut(w, n))
    seen = {n: Counter(x for (x, _), v in c.items() for _ in range(v)) for n, c in counts.items()}
    known = {n: {x for x, v in c.items() if v >= 2} for n, c in seen.items()}
    total = {(n, lang): sum(v for (x, y), v in counts[n].items() if y == lang and x in known[n]) + 0.5 * len(known[n]) for n in counts for lang in langs}
    log = lambda n, x, lang: math.log((counts[n][x, lang] + 0.5) / total[n, lang])
    score = dict.fromkeys(langs, 0.0)
    found = words(text)
    if not found:
        return "und", 0.0
    for w in found:
        if w in known[0]:
            got, n = [w], 0
        else:
            n = next((n for n in (4, 3, 2, 1) if any(g in known[n] for g in cut(w, n))), None)
            got = [g for g in cut(w, n) if g in known[n]] if n else []
        for lang in langs:
            score[lang] += sum(log(n, x, lang) for x in got) / max(1, len(got))
    best = max(score.values())
    lang = next(x for x in langs if score[x] == best)
    return lang, 1 / sum(math.exp(v - best) for v in score.values())


def test_against_a_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    learned = [(r.lang, r.text) for r in rows if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    got = {r.doc_id: r for r in identify(docs).collect()}
    for r in rows[::25]:  # the plain model is slow
        lang, share = plain(learned, r.text)
        assert got[r.doc_id].lang_pred == lang
        assert got[r.doc_id].score == pytest.approx(share, abs=1e-3)


def test_an_item_keeps_the_counts_of_every_language(spark):
    rows = [("x", "shared alpha beta gamma")] * 60 + [("y", "shared delta")] * 3 + [("x", "solitary")] + [("y", "solitary")] + [("y", "once")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    m = train(docs, F.lit(True))
    assert set(m.index[0]) == {"shared", "alpha", "beta", "gamma", "delta", "solitary"}
    freq = np.exp(m.logs[0][m.index[0]["solitary"]])
    assert freq == pytest.approx([1.5 / (241 + 3), 1.5 / (7 + 3)], rel=1e-5)


def test_all_rows_are_learned_from(spark):
    """Each of 3,000 words stands in two of 6,000 rows of a language; a sample of the rows would miss most of them."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:04d}")
    docs = spark.createDataFrame([(k, f"word {word(k // 2)}", "x" if k < 6000 else "y") for k in range(6400)], "doc_id long, text string, lang string")
    m = train(docs, F.lit(True))
    assert set(m.index[0]) == {"word", *(word(k) for k in range(3200))}
    assert np.exp(m.logs[0][m.index[0]["word"]]) == pytest.approx([6000.5 / (12000 + 0.5 * 3201), 400.5 / (800 + 0.5 * 3201)], rel=1e-5)


def test_a_sent_model_is_small(spark):
    """With 60,000 words a model of dictionaries takes 180 bytes a word besides the frequencies, and the counts stay beside it."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:05d}")
    sent = pickle.loads(pickle.dumps(model(["a", "b"], [("ab"[k % 2], 0, word(k), 3) for k in range(60_000)])))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    index = sent.index
    made = tracemalloc.take_snapshot().statistics("filename")
    tracemalloc.stop()
    assert sum(x.size for x in made) + pa.total_allocated_bytes() - arrow < 60_000 * 50
    want = sent.predict(f"{word(3)} {word(59_999)} unseen")
    sent.release()
    assert sent.counts is None
    assert sent.predict(f"{word(3)} {word(59_999)} unseen") == want
    assert want[0] == "b"
    assert set(index[0]) == {word(k) for k in range(60_000)}
    assert index[0].get("aaaa") is None


def test_equal_hashes_are_told_apart():
    """Strings whose hashes are all equal still have places of their own, and a stranger with that hash has none."""
    index = Index(pa.array(["one", "two", "three"]))
    index.hashes[:] = hash("two") % (1 << 64)
    part = int(index.hashes[0] >> index.shift)
    index.starts[: part + 1], index.starts[part + 1 :] = 0, 3
    assert index.places(["two", "four"]).tolist() == [index.items.to_pylist().index("two"), -1]
    index = Index(pa.array(["x", "y"]))
    assert [index.items[k].as_py() for k in index.places(["y", "x", "y"])] == ["y", "x", "y"]
    assert index.places(["z", ""]).tolist() == [-1, -1]
    assert Index(pa.array([], pa.string())).places(["a"]).tolist() == [-1]
