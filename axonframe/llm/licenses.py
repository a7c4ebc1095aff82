"""License scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own phrases: words, label, strength of the evidence.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "mit license": ("mit", 0.6),
    "apache license 2": ("apache-2", 0.7),
    "gnu general public license version 2": ("gpl-2", 0.8),
    "gnu general public license version 3": ("gpl-3", 0.8),
    "gnu general public license v3": ("gpl-3", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.7),
    "bsd 3 clause": ("bsd-3-clause", 0.7),
    "isc license": ("isc", 0.6),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0 1 0": ("cc0", 0.7),
    "released into the public domain": ("public-domain", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
#: Words of the identifier tag, and how it is written; its expression ends with the line or before the next tag.
TAG = "spdx license identifier"
TAG_START = re.compile(r"spdx-license-identifier[ \t]*:")
TAG_END = re.compile(r"[\r\n]|spdx-license-identifier[ \t]*:")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in UTF-8: all characters but the signs of ASCII, after lower-casing
PERMISSIVE = re.compile(r"(mit|apache|bsd|isc|cc0|zlib|unlicense|0bsd|public-domain|cc-by-\d|cc-by$)")

#: Identifiers of the SPDX licence list in lower case, without the suffixes -only, -or-later and +.
KNOWN = frozenset(
    """0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bitstream-vera blueoak-1.0.0 bsd-1-clause bsd-2-clause
    bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cal-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0
    cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0
    cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eudatagrid eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd
    icu ijg imagemagick intel ipa ipl-1.0 isc jasper-2.0 json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 lppl-1.3c mit mit-0 mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0
    ncsa nist-pd ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat sspl-1.0 tcl unicode-3.0
    unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zend-2.0 zlib zpl-2.0 zpl-2.1""".split()
)
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+:-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_SUFFIX = re.compile(r"(-only|-or-later|\+)$")


def is_licence(token: str) -> bool:
    """A known identifier, with or without a version suffix, or a reference to a licence text of one's own."""
    return _SUFFIX.sub("", token) in KNOWN or bool(re.match(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9]", token))


def is_exception(token: str) -> bool:
    """What may stand after ``with``: the listed exceptions' names all hold the word, or end in ``note``."""
    return "exception" in token or token.endswith("-note")


def label_of(identifier: str) -> str:
    """A licence identifier's label: without version suffixes that don't change the licence."""
    x = _SUFFIX.sub("", identifier)
    return re.sub(r"^(gpl|lgpl|agpl|apache|mpl)-(\d+)\.0$", r"\1-\2", x)


def parse(expression: str) -> tuple[list[str], list[str]]:
    """Reverse Polish form of a lower-case licence expression by the shunting-yard method, and its operands.

    ``with`` binds closest, then ``and``, then ``or``; equals associate to the left. Operands are known identifiers
    (:func:`is_licence`), after ``with`` names of exceptions; the expression ends where the text can't continue it, as
    before prose or an unknown word. A dangling operator or open parenthesis at the end is dropped. No operand: two
    empty lists. One pass over the tokens, whatever the nesting.
    """
    out: list[str] = []
    stack: list[str] = []
    operands: list[str] = []
    wants = True  # an operand or "("
    opened = at = 0
    while token := _TOKEN.match(expression, at):
        at, word = token.end(), token[1]
        if word not in _STRENGTH and word not in "()":
            word = word.rstrip(".:-")  # the end of a sentence is no part of a name
        excepted = wants and bool(stack) and stack[-1] == "with"
        if wants and word == "(" and not excepted:
            stack.append(word)
            opened += 1
        elif wants and (is_exception(word) if excepted else is_licence(word)):
            operands.append(word)
            out.append(word)
            wants = False
        elif not wants and word in _STRENGTH:
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[word]:
                out.append(stack.pop())
            stack.append(word)
            wants = True
        elif not wants and word == ")" and opened:
            while (top := stack.pop()) != "(":
                out.append(top)
            opened -= 1
        else:
            break
    while stack and wants:  # what waits for an operand that never comes: parentheses, then the operator before them
        wants = stack.pop() == "("
    out += [x for x in reversed(stack) if x != "("]
    return out, operands


def evaluate(rpn: list[str]) -> tuple[frozenset[str], bool]:
    """Labels that the expression names, and whether it can be met with permissive licences only.

    ``and`` needs both sides, ``or`` either; an exception after ``with`` is no licence and leaves its left side's value.
    """
    stack: list[tuple[frozenset[str], bool]] = []
    for x in rpn:
        if x in _STRENGTH:
            (b, pb), (a, pa_) = stack.pop(), stack.pop()
            stack.append((a, pa_) if x == "with" else (a | b, (pa_ and pb) if x == "and" else (pa_ or pb)))
        else:
            label = label_of(x)
            stack.append((frozenset([label]), bool(PERMISSIVE.match(label))))
    return stack[-1] if stack else (frozenset(), False)


def automaton() -> ahocorasick.Automaton:
    """Of all phrases as words between blanks; a value is (phrase, length in words, kind)."""
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    a.make_automaton()
    return a


def scan_text(text: bytes | None, machine: ahocorasick.Automaton) -> dict:
    """All findings in one UTF-8 text: ``n_words``, ``spans`` (label, first word, words, base or not), ``expressions``, ``score``, ``permissive``."""
    low = (text or b"").lower()  # of bytes: A-Z only
    words = WORD.findall(low)
    spans, expressions, missed, free = [], [], 1.0, []
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    at = index = 0
    tagged = False
    for end, (phrase, n) in machine.iter(line):
        index += line.count(" ", at, end)  # blanks before the phrase's last one: the number of words that end by then
        at = end
        if phrase == TAG:
            tagged = True
            continue
        base = phrase in BASE
        label, strength = (BASE[phrase], 0.9) if base else NOTICES[phrase]
        spans.append((label, index - n, n, base))
        missed *= 1 - strength
        free.append(bool(PERMISSIVE.match(label)))
    if tagged:
        plain = low.decode("utf-8", "replace")
        for m in TAG_START.finditer(plain):
            end = TAG_END.search(plain, m.end())
            rpn, operands = parse(plain[m.end() : end.start() if end else len(plain)])
            labels, ok = evaluate(rpn)
            if operands:
                expressions.append((" ".join(rpn), sorted(labels), ok))
                missed *= 0.05
                free.append(ok)
    return {"n_words": len(words), "spans": spans, "expressions": expressions, "score": 1 - missed, "permissive": all(free) if free else None}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings of each whole document, in Arrow batches where it is read: no shuffle.

    Columns: ``doc_id, n_words, spans array<struct<label, word, n_words, base>>, expressions array<struct<rpn, labels,
    permissive>>, score, permissive``. Spans are all places in word order, overlapping ones each. ``score`` is the
    chance that some finding is right if each fails on its own; 0 without any. ``permissive``: all findings are; null
    without any. Null and empty texts: no words, no findings. Very long texts are scanned whole, in one pass. Repeated rows
    are scanned each, null ids kept; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("base", pa.bool_())]))
        expr = pa.list_(pa.struct([("rpn", pa.string()), ("labels", pa.list_(pa.string())), ("permissive", pa.bool_())]))
        for b in batches:
            got = [scan_text(t.as_py(), machine) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([[dict(zip(("label", "word", "n_words", "base"), s, strict=True)) for s in g["spans"]] for g in got], span),
                    pa.array([[dict(zip(("rpn", "labels", "permissive"), s, strict=True)) for s in g["expressions"]] for g in got], expr),
                    pa.array([g["score"] for g in got], pa.float64()),
                    pa.array([g["permissive"] for g in got], pa.bool_()),
                ],
                ["doc_id", "n_words", "spans", "expressions", "score", "permissive"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<label string, word long, n_words long, base boolean>>, expressions array<struct<rpn string, labels array<string>, permissive boolean>>, score double, permissive boolean")


def license_digest(found: DataFrame) -> DataFrame:
    """One flat row a document from :func:`scan_licenses`; labels are distinct, sorted and joined by commas."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["word"])
    labels = F.array_union(F.transform("spans", lambda s: s["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda s: s["label"])).alias("base_labels"), joined(labels).alias("labels"), "score", "permissive",
    )
