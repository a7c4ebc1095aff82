"""Language ID by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = re.compile(r"[^\W\d_]+")
SIZES = (4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return RUN.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word with its edges marked; single characters without the marks."""
    if n == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Index(Mapping):
    """Places of distinct strings: some 20 bytes and the string's own a piece, a small part of what a dictionary of them takes.

    The strings are sorted by Python's hash, which holds in this process only; an equal hash is always confirmed on the string.
    """

    def __init__(self, items: pa.Array) -> None:
        h = np.empty(len(items), dtype=np.int64)
        for k in range(0, len(h), 10_000):  # all as Python's strings at once would take more than the rest
            h[k : k + 10_000] = [hash(x) for x in items.slice(k, 10_000).to_pylist()]
        h = h.view(np.uint64)
        self.order = np.argsort(h).astype(np.int32)  # until the caller has sorted what belongs to the strings
        self.hashes, self.items = h[self.order], items.take(pa.array(self.order))
        bits = max(1, len(h).bit_length())  # half a string to one for each value of so many bits
        self.shift = np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int32), minlength=1 << bits), out=self.starts[1:])

    def places(self, strings: list[str]) -> np.ndarray:
        """The place of each string, -1 where it isn't there."""
        out = np.full(len(strings), -1)
        h = np.fromiter(map(hash, strings), dtype=np.int64, count=len(strings)).view(np.uint64)
        part = (h >> self.shift).astype(np.int64)
        at, end, live = self.starts[part], self.starts[part + 1], np.arange(len(strings))
        maybe = np.full(len(strings), -1, dtype=np.int32)
        while len(live := live[at[live] < end[live]]):
            k = at[live]
            equal = self.hashes[k] == h[live]
            maybe[live[equal]] = k[equal]
            live = live[~equal]
            at[live] += 1
        found = np.flatnonzero(maybe >= 0)
        if len(found):
            k = maybe[found]
            some = strings if len(found) == len(strings) else [strings[i] for i in found.tolist()]
            same = pa.compute.equal(self.items.take(pa.array(k)), pa.array(some, self.items.type))
            if same.true_count == len(found):
                out[found] = k
            else:
                same = same.to_numpy(zero_copy_only=False)
                out[found[same]] = k[same]
                for i in found[~same].tolist():  # another string of that hash; the string's own place may be a later one
                    out[i] = next((j for j in range(maybe[i] + 1, end[i]) if self.hashes[j] == h[i] and self.items[j].as_py() == strings[i]), -1)
        return out

    def __getitem__(self, string: str) -> int:
        if (k := int(self.places([string])[0])) < 0:
            raise KeyError(string)
        return k

    def __iter__(self) -> Iterator[str]:
        return iter(self.items.to_pylist())

    def __len__(self) -> int:
        return len(self.items)


class Model:
    """Log frequencies by language of known words, and of n-grams of each size for all other words."""

    def __init__(self, langs: list[str], counts: pa.Table, smooth: float = 0.5) -> None:
        """``counts``: ``lang, kind`` (0 for a word, else the size of an n-gram), ``item, n``.

        Only these go to the tasks, which make their own indices of them, and keep no counts: the driver needs none.
        """
        self.langs, self.counts, self.smooth = langs, counts, smooth

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("langs", "counts", "smooth")}

    def release(self) -> None:
        """Keeps what predictions need and forgets the counts; such a model can't be sent on."""
        self._tables  # noqa: B018
        self.counts = None
        pa.default_memory_pool().release_unused()

    @cached_property
    def _tables(self) -> tuple[list[Index], list[np.ndarray]]:
        index, logs = [], []
        for kind in range(max(SIZES) + 1):
            some = self.counts.filter(pa.compute.equal(self.counts["kind"], kind)).select(["lang", "item", "n"])
            items = some["item"].combine_chunks().dictionary_encode()
            m = np.full((len(items.dictionary), len(self.langs)), self.smooth)
            np.add.at(m, (items.indices.to_numpy(), pa.compute.index_in(some["lang"], pa.array(self.langs, pa.string())).to_numpy()), some["n"].to_numpy())
            if len(m):
                m /= m.sum(axis=0)
                np.log(m, out=m)
            index.append(Index(items.dictionary))
            logs.append(m.astype(np.float32)[index[-1].order])
            del index[-1].order, some, items, m
        return index, logs

    @property
    def index(self) -> list[Index]:
        return self._tables[0]

    @property
    def logs(self) -> list[np.ndarray]:
        return self._tables[1]

    def scores(self, text: str) -> np.ndarray | None:
        """Summed log frequencies by language; None if the text has no letter.

        A known word counts by its own frequencies. An unseen one counts as the mean over its longest n-grams of
        which any is known; if not even a character is known, it says nothing.
        """
        words = Counter(words_of(text))
        if not any(any(map(str.isalpha, w)) for w in words):
            return None
        total = np.zeros(len(self.langs))
        if not self.langs:
            return total
        indices, logs = self._tables
        left, n = list(words), np.fromiter(words.values(), dtype=float, count=len(words))
        at = indices[0].places(left)
        known = at >= 0
        total += n[known] @ logs[0][at[known]]
        for size in SIZES:
            rest = np.flatnonzero(~known)
            if not len(rest):
                break
            left, n = [left[k] for k in rest.tolist()], n[rest]
            cut = [grams(w, size) for w in left]
            at = indices[size].places([g for each in cut for g in each])
            owner = np.repeat(np.arange(len(left)), [len(each) for each in cut])[at >= 0]
            each = np.bincount(owner, minlength=len(left))
            total += (n[owner] / each[owner]) @ logs[size][at[at >= 0]]
            known = each > 0
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood (equal priors; ties: the first by code point)."""
        s = self.scores(text) if text else None
        if s is None or not len(s):
            return "und", 0.0
        p = np.exp(s - s.max())
        k = int(np.argmax(p))
        return self.langs[k], float(p[k] / p.sum())


def _flushed(held: Counter, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The counts of tuples as rows, in batches; the counter is empty afterwards."""
    rows = list(held.items())
    held.clear()
    for k in range(0, len(rows), 20_000):
        part = rows[k : k + 20_000]
        columns = [*zip(*[x[0] for x in part], strict=True), [x[1] for x in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def counted(labelled: DataFrame) -> DataFrame:
    """``lang, kind, item, n`` of the words and n-grams of ``lang, text``.

    Words are counted by task before the shuffle, and n-grams from the counts of distinct words: a text is only cut into words.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        names, types = ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, c in Counter(words_of(text)).items():
                    held[lang, w] += c
                if len(held) > 200_000:
                    yield from _flushed(held, names, types)
        yield from _flushed(held, names, types)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        names, types = ["lang", "kind", "item", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
        for b in batches:
            for lang, w, n in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                held[lang, 0, w] += n
                for size in SIZES:
                    for g in grams(w, size):
                        held[lang, size, g] += n
                if len(held) > 200_000:
                    yield from _flushed(held, names, types)
        yield from _flushed(held, names, types)

    by_word = labelled.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return by_word.mapInArrow(items, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column, sample_docs: int | None = None, least: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows where ``learn`` holds and text and language are not null.

    Of these rows, in whole texts, the model has all words and n-grams seen ``least`` times or more in all languages together, with the counts
    of every language; what was seen once only is as good as unseen, and shorter n-grams speak for it. The counts come to the driver
    and go back to the tasks: they grow with the vocabulary, not with the text. ``sample_docs``: if given, only about as many rows a language, by a hash of the id.
    No labelled row: a model without languages.
    """
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("h"))
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if sample_docs is not None:
        full = float(1 << 31)
        keep = F.lit(False)
        for lang, n in size.items():
            keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 31)) < F.lit(full * min(1.0, sample_docs / n))))
        rows = rows.filter(keep)
    items = counted(rows).groupBy("kind", "item").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("counts")).filter(F.col("total") >= least)
    return Model(sorted(size), items.select("kind", "item", F.explode("counts").alias("c")).select("c.lang", "kind", "item", "c.n").toArrow())


def prediction(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` for the text column; only the text goes to Python, only the struct comes back.

    The model goes to the tasks as a broadcast variable. ``und`` with score 0 for a null text, one without a letter, or
    an empty model. Whole texts are scored; no shuffle.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        m.release()
        for texts in batches:
            got = [m.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["lang_pred", "score"])

    # not to be computed again for a filter on it
    return F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1. Null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: object) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, by a model learned from the rows not held out.

    Repeated rows and null ids are kept; very long texts are scored whole; an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), prediction(docs.sparkSession, model, text_col).alias("p"))
    return slim.select("doc_id", "held_out", "p.lang_pred", "p.score")
