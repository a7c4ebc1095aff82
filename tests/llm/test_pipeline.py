"""The pipeline's stages against plain versions of what each must do with its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from axonframe.llm._common import saved
from axonframe.llm.packing import Encoder
from test_minhash import brute as near_groups


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, sf), name)
        rows = out.collect()
        if name != "packing":
            assert out.dtypes == spark.read.parquet(f"{sf}/documents.parquet").dtypes
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert ids == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "quality":
            clean = {i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
            assert len(ids & clean) >= 0.95 * len(clean)
            assert len(ids) < len(before)
        elif name == "near_dedup":
            groups = near_groups([(i, r.text) for i, r in before.items()], 5)
            assert ids == {i for i, (_, c) in groups.items() if i == c}
            assert len(rows) == len(ids)
        elif name == "mixing":
            words = defaultdict(int)
            for r in rows:
                n = len(r.text.split())
                assert n and r.n_chars == len(r.text)
                assert re.sub(r"\s+", " ", r.text) in re.sub(r"\s+", " ", before[r.doc_id].text) or n < len(before[r.doc_id].text.split())
                words[r.doc_id] += n
            size = {i: len(r.text.split()) for i, r in before.items()}
            assert all(words[i] <= 2 * size[i] for i in words)
            assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 0.03 * sum(size.values())
        else:
            texts = defaultdict(list)
            for r in before_rows:
                texts[r.doc_id].append(r.text)
            encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
            want, got = defaultdict(int), defaultdict(int)
            for i, each in texts.items():
                want[i] = sum(len(encode(t)) + 1 for t in each)
            for r in rows:
                got[r.doc_id] += r.length
            assert got == want
        before_rows = rows
        before = {r.doc_id: r for r in rows} if name != "packing" else before
        docs = out


ORDER = [n for n, _ in corpus_pipeline.STAGES]


@pytest.fixture
def tables(spark, tmp_path):
    """Odd documents with labels in a folder of their own."""

    def put(rows, schema="doc_id long, text string, lang string, source string, n_chars long, id string, t int, doc string, kept boolean, group long, k int"):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (20, 0, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return put


def odd_rows():
    base = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood at night "
    german = "der schnelle braune Fuchs springt und die faulen Hunde im Wald bei Nacht laufen weit weg von allen anderen Tieren "
    row = lambda i, text, lang="en", source="a", other=1: (i, text, lang, source, None if text is None else len(text), "x", other, "d", True, 5, None)
    rows = [row(k, f"{base} number {k} of {'abcdefgh'[k % 8] * 3} {'pqrs'[k % 4] * 4} " * 2) for k in range(1, 9)]
    rows += [row(k, f"{german} Nummer {k} von {'abcdefgh'[k % 8] * 3} {'pqrs'[k % 4] * 4} " * 2, "de", "b") for k in range(10, 18)]
    return [
        *rows,
        rows[0],  # a repeated row
        (*rows[0][:6], 2, *rows[0][7:]),  # the same but for another column
        row(1, f"{german} ein ganz anderer Text unter derselben Nummer eins", "de", "b"),
        row(1, f"{base} and one more text that has the number one", "en", None),
        row(30, rows[1][1]),  # a copy
        row(None, f"{base} a row without an id", "en", "c"),
        row(None, f"{base} a row without an id", "en", "c"),
        row(31, None), row(31, None), row(32, ""), row(33, " \t\n"), row(34, "123 !!!"),
        row(35, f"{base} long " * 3000),
        (None,) * 11,
    ]


def ids_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_odd_rows_through_all_stages(spark, tables):
    sf = tables(odd_rows())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    now = docs
    for name in ORDER[:-1]:
        out = saved(stages[name](spark, now, sf), name)
        assert out.dtypes == docs.dtypes
        again = stages[name](spark, now.repartition(5), sf)
        assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))  # reruns agree
        kept[name], now = out, out
    rows = odd_rows()
    letters = sorted((r[0] if r[0] is not None else -1, r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert ids_of(kept["language_id"]) == letters
    near = ids_of(stages["near_dedup"](spark, docs, sf))
    texts = [(i, t) for i, t in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})]
    groups = near_groups(list(enumerate(t for _, t in texts)), 5)
    firsts = [texts[k] for k, (_, c) in groups.items() if texts[k][0] == min(texts[j][0] for j, (_, d) in groups.items() if d == c)]
    by_group = {}
    for k, (_, c) in groups.items():
        by_group.setdefault(c if texts[k][1].split() else (c, k), []).append(texts[k])
    got = [x for x in near if x[0] != -1]
    assert len(got) == len(by_group) and set(got) <= set(firsts)
    for members in by_group.values():
        assert sum(x in got for x in members) == 1
    assert [x for x in near if x[0] == -1] == sorted((-1, r[1] or "") for r in rows if r[0] is None)
    packed = stages["packing"](spark, now, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}


def test_empty_table_and_whole_run(spark, tables):
    sf = tables(odd_rows())
    assert corpus_pipeline.run(spark, sf).count() > 0
    sf = tables([])
    assert corpus_pipeline.run(spark, sf).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_ids_of_three_texts(spark, tables):
    """All of an id's texts come through."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[k * 20 : k * 20 + 20]), "en", "a", 9, "x", 1, "d", True, 5, 1) for k, i in enumerate((1, 1, 2))]
    sf = tables(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert ids_of(corpus_pipeline.near_dedup(spark, docs, sf)) == sorted((r[0], r[1]) for r in rows)
