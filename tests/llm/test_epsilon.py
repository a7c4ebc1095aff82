import math

import numpy as np
import pytest

from axonframe.llm.epsilon import embedding_groups, interval_join


def brute(rows, cosine=0.9):
    """Links and components by looking at all pairs."""
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    link = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    link[a].append(b)
    label = {k: rows[k][0] for k in link}
    while True:
        new = {k: min([label[k], *(label[j] for j in link[k])]) if link[k] else label[k] for k in link}
        if new == label:
            break
        label = new
    return sorted((rows[k][0] if rows[k][0] is not None else -1, len(link[k]), label[k] if label[k] is not None else -1) for k in link)


def found(df, **options):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in embedding_groups(df, **options).collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, dims))
    rows = [(i, (centers[i % 5] + rng.normal(size=dims) * rng.choice([0.1, 0.3, 2.0])).tolist()) for i in range(n)]
    return rows + [(n + k, rows[3][1]) for k in range(6)]


@pytest.mark.parametrize(("n", "dims", "block"), [(120, 6, 16), (150, 24, 40), (40, 3, 8192)])
def test_against_brute_force(spark, n, dims, block):
    rows = clustered(n, dims, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, block_rows=block) == brute(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0, 0.0]), (8, [1e300, 0.0]), (9, [1e-300, -0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (11, [0.9, math.sqrt(1 - 0.81) + 1e-9]), (12, [0.0, 5.0])]
    df = spark.createDataFrame([(*r, 3, 4, True) for r in rows], "vec_id long, embedding array<double>, label int, n int, kept boolean")
    assert found(df) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in embedding_groups(df).collect())
    assert embedding_groups(df.filter("false")).count() == 0
    assert embedding_groups(df.filter("vec_id < 7")).filter("n_links > 0").count() == 0


def test_skipped_intervals_hold_no_near_pair():
    rng = np.random.default_rng(0)
    a = np.sort(rng.uniform(-1, 1, (400, 1)), axis=0)
    eps = 0.05
    cells = np.floor(a / (eps / 4)).astype(int)
    near = np.abs(a - a.T) <= eps
    seen = np.zeros_like(near)
    for s, t in interval_join(a, a, cells, cells, 4, eps * eps, leaf=10, same=True):
        seen[s, t] = True
    assert not (near & ~(seen | seen.T)).any()
    assert seen.mean() < 0.3
