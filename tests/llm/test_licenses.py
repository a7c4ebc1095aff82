import random
import re

import pytest

from axonframe.llm.licenses import BASE, automaton, evaluate, license_digest, parse, scan_licenses, scan_text


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "under the mit license under the mit license UNDER-THE-MIT-LICENSE",
    "Apache License, Version 2.0; not apache license version 20; apache license version 2",
    "été cc by-nc 4.0 É CC BY NC\x00cc by nc",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest",
]


def test_texts_against_brute_force():
    a = automaton()
    for t in TEXTS:
        got = scan_text(None if t is None else t.encode(), a)
        base = [s for s in got["spans"] if s[3]]
        starts = [s[1] for s in base]
        assert (got["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[0] for s in base}))) == brute(t)
        assert 0 <= got["score"] <= 1


@pytest.mark.parametrize(
    ("text", "rpn"),
    [
        ("mit or apache-2.0 and bsd-3-clause", "mit apache-2.0 bsd-3-clause and or"),
        ("(mit or apache-2.0) and isc", "mit apache-2.0 or isc and"),
        ("gpl-2.0-only with classpath-exception-2.0 or mit", "gpl-2.0-only classpath-exception-2.0 with mit or"),
        ("mit this file is free", "mit"),
        ("mit and", "mit"),
        ("(mit or isc", "mit isc or"),
        (") or", ""),
        ("(mit or", "mit"),
        ("((mit and (", "mit"),
        ("mit or isc and ((gpl-2.0 with", "mit isc gpl-2.0 and or"),
        ("mit with isc", "mit"),
        ("classpath-exception-2.0", ""),
        ("see the copying file", ""),
        ("mit or whatever", "mit"),
        ("mit. all rights", "mit"),
        ("licenseref-own-1 or documentref-x:licenseref-2", "licenseref-own-1 documentref-x:licenseref-2 or"),
        ("apache-2.0+ */ and mit", "apache-2.0+"),
        ("", ""),
    ],
)
def test_shunting_yard(text, rpn):
    assert " ".join(parse(text)[0]) == rpn


def test_any_token_string_ends():
    rng = random.Random(3)
    tokens = ["(", ")", "and", "or", "with", "mit", "gpl-2.0-only", "classpath-exception-2.0", "word", "*/"]
    for _ in range(100_000):
        rpn, operands = parse(" ".join(rng.choices(tokens, k=rng.randint(0, 9))))
        assert [x for x in rpn if x not in ("and", "or", "with")] == operands
        labels, _ = evaluate(rpn)  # a well-formed reverse Polish form leaves one value
        assert bool(labels) == bool(operands)
    deep = "(" * 200_000 + "mit" + ")" * 200_000
    assert parse(deep) == (["mit"], ["mit"])


def shown(tree):
    return tree if isinstance(tree, str) else "(" + f" {tree[0]} ".join(map(shown, tree[1:])) + ")"


def value(tree):
    if isinstance(tree, str):
        return tree in ("mit", "isc")
    a, b = map(value, tree[1:])
    return a and b if tree[0] == "and" else a or b


def test_values_of_random_trees():
    rng = random.Random(4)
    grow = lambda d: rng.choice(["mit", "isc", "gpl-2.0", "mpl-2.0"]) if not d or rng.random() < 0.2 else (rng.choice(["and", "or"]), grow(d - 1), grow(d - 1))
    for _ in range(2000):
        tree = grow(5)
        assert evaluate(parse(shown(tree))[0])[1] == value(tree)


def test_tags():
    a = automaton()
    one = lambda t: [(e[0], e[2]) for e in scan_text(t.encode(), a)["expressions"]]
    assert one("SPDX-License-Identifier: (MIT OR") == [("mit", True)]
    assert one("SPDX-License-Identifier: see the COPYING file") == []
    assert one("x SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0 y") == [("mit", True), ("gpl-2.0", False)]
    assert one("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC\nAND GPL-2.0") == [("mit", True), ("isc", True)]


def test_evaluation():
    assert evaluate(parse("gpl-3.0-only or mit")[0]) == ({"gpl-3", "mit"}, True)
    assert evaluate(parse("gpl-3.0-only and mit")[0]) == ({"gpl-3", "mit"}, False)
    assert evaluate(parse("gpl-2.0-only with classpath-exception-2.0")[0]) == ({"gpl-2"}, False)
    assert evaluate([]) == (frozenset(), False)


def test_table(spark, odd_docs, no_docs):
    rows = license_digest(scan_licenses(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    assert next(r for r in rows if r.doc_id == 7).n_base == 4000
    assert license_digest(scan_licenses(no_docs)).count() == 0


def test_query_against_brute_force(spark, sf):
    from axonframe.llm.queries import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries()["op1_license_scan"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
