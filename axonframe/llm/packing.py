"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """At most ``most`` open windows of ``size`` tokens that are filled online.

    ``levels[h]`` is the number of open windows filled to h, ``at[h]`` those windows. An item of s tokens goes where
    the sum of squared counts of partially filled windows gets smallest: into a window at some h with h + s <= size,
    or into a new one (h = 0) while fewer than ``most`` are open. Ties: the fullest window. Where none of these is left, the item is cut: it fills
    up a window at some h > size - s and its rest opens a new one, again so that the squared counts get smallest.
    Only the two counts that change decide, so a choice is one pass over the level array.
    """

    def __init__(self, size: int, most: int = 64) -> None:
        self.size, self.most, self.open = size, most, 0
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.at: list[list[list]] = [[] for _ in range(size + 1)]

    def choose(self, s: int) -> int:
        """The fill level that an item of s tokens goes to; over size - s if it is to be cut."""
        n, top = self.levels, self.size - s
        never = np.iinfo(np.int32).max
        fall = np.where(n > 0, 1 - 2 * n, never)  # to (N-1)^2 at the old level
        fall[0] = 0 if self.open < self.most else never  # a new window
        rise = 2 * n + 1  # to (N+1)^2 at the new one ...
        rise[self.size] = 0  # ... but a full window counts no more
        cost = rise[s:] + fall[: top + 1]
        h = top - int(np.argmin(cost[::-1]))
        if cost[h] < never // 2:
            return h
        cost = rise[1:s] + fall[top + 1 : self.size]  # cut at h, and the rest is at h + s - size
        return self.size - 1 - int(np.argmin(cost[::-1]))

    def put(self, item: tuple, s: int, cut: Callable[[tuple, int], tuple[tuple, tuple]]) -> list | None:
        """Places the item; the window's items if one is full now. ``cut(item, k)`` gives the first k tokens and the rest."""
        h = self.choose(s)
        window = self.at[h].pop() if h else []
        self.levels[h] -= bool(h)
        self.open += not h
        if h + s > self.size:
            first, rest = cut(item, self.size - h)
            window.append((first, self.size - h))
            self.levels[h + s - self.size] += 1
            self.at[h + s - self.size].append([(rest, h + s - self.size)])
            return window
        window.append((item, s))
        if h + s == self.size:
            self.open -= 1
            return window
        self.levels[h + s] += 1
        self.at[h + s].append(window)
        return None

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for h in range(self.size, 0, -1) for w in self.at[h]]


def pack_items(items: Iterable[tuple[object, int]], size: int, cut: Callable[[object, int], tuple] | None = None, most: int = 64, moved: list[int] | None = None) -> Iterator[list[tuple[object, int]]]:
    """Sequences of pieces ``(item, length)``, all full but those of the last few tokens, which are powers of two long.

    ``cut(item, k)`` parts an item after its first k tokens; by default items are triples (name, start, length).
    Items longer than a window first give full windows; what is left of each goes through :class:`Windows`. At the
    end, the fullest of the windows still open are filled up with tokens from the emptiest, and the last one becomes
    a sequence for each binary digit of its length, which needs no padding. Only these tokens lie elsewhere than the rule put them, under
    ``most * size`` of them; ``moved`` gets their number.
    """
    cut = cut or (lambda x, k: ((x[0], x[1], k), (x[0], x[1] + k, x[2] - k)))
    windows = Windows(size, most)
    for item, n in items:
        while n >= size:
            first, rest = cut(item, size) if n > size else (item, None)
            yield [(first, size)]
            item, n = rest, n - size
        if n and (full := windows.put(item, n, cut)):
            yield full
    left = windows.rest()
    count = 0

    def taken(window: list, k: int) -> list:
        """k tokens off the window's end."""
        out = []
        while k:
            item, m = window.pop()
            if m > k:
                item, last = cut(item, m - k)
                window.append((item, m - k))
                item, m = last, k
            out.append((item, m))
            k -= m
        return out

    while len(left) > 1:
        gap = size - sum(m for _, m in left[0])
        if gap:
            k = min(gap, sum(m for _, m in left[-1]))
            left[0] += taken(left[-1], k)
            count += k
            if not left[-1]:
                left.pop()
        else:
            yield left.pop(0)
    if left:
        n = sum(m for _, m in left[0])
        while n:
            k = size if n >= size else 1 << (n.bit_length() - 1)
            count += k if k < n else 0
            yield taken(left[0], k)
            n -= k
    if moved is not None:
        moved.append(count)


class Encoder:
    """Ids of a tokenizer file of the ``tokenizers`` library.

    For a byte-level BPE without normalizer, whose ids rise with its merges' ranks, the same vocabulary is run by
    ``tiktoken``, which is several times faster. That both give the same ids is verified on a probe when the
    worker starts and then on every :data:`EACH`-th text: texts are encoded in runs, a run's ids are used only if the
    libraries agree on its sample, and else it and all later ones go through ``tokenizers``. So do texts with a special token's
    string, texts that the fast path refuses, and all texts for other tokenizers.
    """

    EACH = 50
    PROBE = "It's 3 o'clock -- ÉTÉ naïve \t\n\n  x ﬁ  \U0001f600 übergrößenträger 12345 ###&&& '' ‍́ \r\n"

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") == "BPE" and not spec.get("normalizer") and plain and split and self._ranked(model):
            self.fast = self._ranks(spec["model"]["vocab"])
        if self.fast and self.fast.encode_ordinary(self.PROBE) != self._exact(self.PROBE):
            self.fast = None

    @staticmethod
    def _ranked(model: dict) -> bool:
        """Whether ids rise with the ranks of the merges that make them."""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ids = [model["vocab"].get("".join(m), -1) for m in pairs]
        return all(a < b for a, b in pairwise(ids)) and (not ids or ids[0] >= 0)

    def _ranks(self, vocab: dict[str, int]) -> object:
        try:
            import tiktoken

            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
            of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, KeyError, ValueError):
            return None

    def _exact(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self._exact(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a very long run can exhaust the pattern engine, which panics
            if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return self._exact(text)


    def run(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of some texts; null is empty."""
        got = [self(t) if t else [] for t in texts]
        if self.fast is not None and any(got[k] != self._exact(texts[k]) for k in range(0, len(texts), self.EACH) if texts[k]):
            self.fast = None
            return [self._exact(t) if t else [] for t in texts]
        return got


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, most: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens; one row a piece of a document.

    Each input partition is packed on its own where it is read: no shuffle. A task holds the ids of pieces in open windows, at most
    ``most * size`` of them, and those of the run of texts that is being encoded; a window that is full leaves with its
    checksums. A sequence's id is the partition's number and a counter, so a task that runs again after a lost
    executor gives the same ids for the same input split.
    Null or empty text: one piece with the end id. Null ids are carried through. Repeated rows are packed each. Very long texts are cut into full
    windows. An empty table gives no rows. Other columns are ignored. ``tokenizer`` is a path that each executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = part = None

        def items() -> Iterator[tuple[tuple, int]]:
            """Pieces ``(doc, start, ids, tokens of the document)`` that are whole documents."""
            nonlocal encode, part
            for batch in batches:
                if part is None and batch.num_rows:
                    part, encode = batch.column(2)[0].as_py(), Encoder(tokenizer)
                for at in range(0, batch.num_rows, Encoder.EACH):
                    some = batch.slice(at, Encoder.EACH)
                    for doc, ids in zip(some.column(0).to_pylist(), encode.run(some.column(1).to_pylist()), strict=True):
                        yield (doc, 0, np.array([*ids, end_id], dtype="<u4"), len(ids) + 1), len(ids) + 1

        def cut(piece: tuple, k: int) -> tuple[tuple, tuple]:
            doc, start, ids, n = piece
            return (doc, start, ids[:k], n), (doc, start + k, ids[k:].copy(), n)

        cols: list[list] = [[] for _ in range(7)]

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in cols:
                c.clear()
            return out

        for n, sequence in enumerate(pack_items(items(), size, cut, most)):
            offset = 0
            for (doc, start, ids, tokens), length in sequence:
                for c, x in zip(cols, (doc, start, length, zlib.crc32(ids.tobytes()), tokens, (part << 40) + n, offset), strict=True):
                    c.append(x)
                offset += length
            if len(cols[0]) >= 10_000:
                yield made()
        if cols[0]:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(run, SCHEMA)
