import numpy as np
import pytest

from axonframe.llm import _common
from axonframe.llm.hamming import masks, nearest_codes, segment_widths, top_k


def brute(rows, k, every):
    codes = {i: np.array([x is not None and x == x and x > 0 for x in v]) for i, v in rows if v is not None and i is not None}
    want = set()
    for q in codes:
        if q % every == 0:
            near = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:k]
            want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return want


def vectors(n, dims, seed, hot=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(n)]
    for i in range(hot):
        rows[i * 2] = (i * 2, rows[0][1])
    return rows


@pytest.mark.parametrize(("n", "dims", "hot"), [(150, 24, 0), (200, 64, 60), (6, 5, 0)])
def test_against_brute_force(spark, n, dims, hot):
    rows = vectors(n, dims, n, hot)
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=10)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 10)


def test_hot_segment_values_are_dealt(spark, monkeypatch):
    """Many different codes with the same first half."""
    monkeypatch.setattr(_common.hot_keys, "__defaults__", (5, 1 << 40))
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 12 + rng.normal(size=12).tolist()) for i in range(120)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=10)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, None, float("nan"), -1.0]), (0, [1.0, None, float("nan"), -1.0]), (10, None), (20, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 1.0, 1.0, 1.0]), (3, [float("inf"), -0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, s0 string")
    got = {tuple(r) for r in top_k(df, k=2, every=10).collect()}
    assert got == brute(dict(rows[1:]).items(), 2, 10)
    assert top_k(df.filter("false")).count() == 0


def test_segments_and_masks():
    for dims in (1, 5, 64, 100):
        for rows in (0, 1, 500, 10**9):
            w = segment_widths(dims, rows)
            assert sum(w) == dims and max(w) <= 16 and min(w) >= 1
    assert sorted(masks(3, 2)) == [3, 5, 6]
    assert nearest_codes.__doc__
