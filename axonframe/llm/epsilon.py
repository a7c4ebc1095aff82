"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, dropped, hot_keys, salted_join, saved


def _matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column]).reshape(-1, dims)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def interval_join(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, apart: int, eps2: float, leaf: int = 512, same: bool = False) -> Iterator[tuple[slice, slice]]:
    """Pairs of intervals of two sequences in grid order that may hold vectors nearer than epsilon.

    ``ca`` and ``cb`` are cells on the leading axes. Two intervals are skipped if on some axis their cell ranges
    lie more than ``apart`` cells from each other, or if their bounding boxes over all axes are too distant. Others are
    halved, the longer first, down to ``leaf`` rows. ``same``: the sequences are one, and each pair comes once.
    """
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, n = stack.pop()
        if i >= j or k >= n or same and k + n < i + j:
            continue
        x, y = ca[i:j], cb[k:n]
        if x.shape[1] and (np.any(x.min(0) > y.max(0) + apart) or np.any(y.min(0) > x.max(0) + apart)):
            continue
        gap = np.maximum(0, np.maximum(a[i:j].min(0) - b[k:n].max(0), b[k:n].min(0) - a[i:j].max(0)))
        if gap @ gap > eps2:
            continue
        if j - i <= leaf and n - k <= leaf:
            yield slice(i, j), slice(k, n)
        elif same and (i, j) == (k, n):
            mid = (i + j) // 2
            stack += [(i, mid, i, mid), (i, mid, mid, j), (mid, j, mid, j)]
        elif j - i >= n - k:
            mid = (i + j) // 2
            stack += [(i, mid, k, n), (mid, j, k, n)]
        else:
            mid = (k + n) // 2
            stack += [(i, j, k, mid), (i, j, mid, n)]


def join_blocks(left: tuple, right: tuple | None, cosine: float, apart: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two blocks (id, weight, vectors, unit vectors on the principal axes, cells), or of one with itself.

    Returns for each row of both how many vectors it links with (by the other's weight), and a spanning forest of the
    links: at most as many edges as rows, not all pairs.
    """
    (ia, wa, va, a, ca), (ib, wb, vb, b, cb) = left, right or left
    offset = 0 if right is None else len(ia)
    na, nb = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ib), dtype=np.int64)
    forest, edges = Forest(len(ia) + (0 if right is None else len(ib))), []
    ids = ia if right is None else np.concatenate([ia, ib])
    eps2 = 2 * (1 - cosine) + 1e-9
    for s, t in interval_join(a, b, ca, cb, apart, eps2, same=right is None):
        c = a[s] @ b[t].T
        hit = c >= cosine
        for p, q in zip(*np.nonzero(np.abs(c - cosine) < 1e-12), strict=True):  # the turn's rounding doesn't decide: the plain cosine does
            x, y = va[s][p], vb[t][q]
            hit[p, q] = x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= cosine
        if right is None and s == t:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        na[s] += hit @ wb[t]
        if right is not None or s != t:
            nb[t] += wa[s] @ hit
        # one link a row and component is enough: with the first of each row, then what those leave apart
        x, y = np.nonzero(hit)
        x, y = x + s.start, y + t.start + offset
        roots = np.array([forest.root(int(v)) for v in range(len(ids))]) if len(x) > 4 * len(ids) else None
        if roots is not None:
            apart_ = roots[x] != roots[y]
            x, y = x[apart_], y[apart_]
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            if forest.join(p, q):
                edges.append((int(ids[p]), int(ids[q])))
    return na, nb, edges


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, grid_dims: int = 8, fine: int = 4, block_rows: int = 32768, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each vector; links are pairs with a cosine of at least ``cosine``.

    Unit vectors with cosine c lie sqrt(2 - 2c) = epsilon apart.
    1. Equal vectors are one entry with a weight (its smallest id stands for it; equal vectors link with each other).
    2. Axes: principal directions of all entries (each task adds up outer products; the sum has dims^2 numbers). Cells on
       the ``grid_dims`` leading ones are epsilon / ``fine`` wide. A range partitioning sorts the entries by cells,
       and is cut into blocks of at most ``block_rows`` (smaller ones in a small table, which should still make eight),
       written to the shared folder, so that blocks stay as they are. A vector is sent once for each block that its own one may be near to.
    3. Blocks are joined pairwise, each pair of blocks in a task of its own; those whose boxes are provably distant are
       dropped before any vector is sent. Inside, intervals of the sorted sequences are halved and skipped while
       provably distant, and what is left is one matrix product in double precision. Exact for every skip.
    4. A task returns link counts by row and a spanning forest, so groups of copies give no quadratic output;
       components come from the forests.
    Blocks are paired range by range of neighbours: only the boxes of at most 2048 ranges come to the driver and go back
    by broadcast, whatever the input; those of blocks stay in a table. In evenly spread high-dimensional data few blocks are
    provably distant, and the work is then the square of the rows, in matrix products: an exact join of such data has no known better bound.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
    don't link. Repeated rows link with each other, as equal vectors with one id; null ids don't link. An empty table gives no rows. Other columns are ignored.
    """
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x)
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # -0.0 and 0.0 are one value
    rows = saved(rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)))), "vectors")
    entries = saved(rows.filter("ok").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "entries")
    spark, out = vectors.sparkSession, []
    sizes = [r.d for r in entries.select(F.size("v").alias("d")).distinct().collect()]  # one row a vector length
    for dims in sizes:
        out.append(_joined(entries.filter(F.size("v") == dims), dims, cosine, min(grid_dims, dims), fine, block_rows))
    found = spark.createDataFrame([], "a long, b long, links long")
    for x in out:
        found = found.union(x)
    comp = components(found.filter("links = 0").select("a", "b"))
    linked = found.filter("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = entries.select("v", F.col("id").alias("rep"), "n").join(linked, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    hot = hot_keys(entries.select("v", F.col("n").alias("m")), ["v"], rows.count())
    good = salted_join(rows.filter("ok").select("id", "v"), known, ["v"], hot, ["id"]).select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    got = saved(good.union(alone), "groups")
    dropped(rows, entries, *out)
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _joined(entries: DataFrame, dims: int, cosine: float, grid: int, fine: int, block_rows: int) -> DataFrame:
    """Of entries of one length: rows with ``links``, the link count of ``a``, and rows with ``links`` 0, the forests' edges ``a, b``."""
    spark = entries.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((dims, dims))
        for b in batches:
            u = _unit(_matrix(b.column(0).to_pylist(), dims))
            s += u.T @ u
        i = np.arange(dims * dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(s.ravel())], ["at", "s"])

    got = entries.select("v").mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()  # dims^2 numbers
    axes = np.linalg.eigh(np.array([r.s for r in got]).reshape(dims, dims))[1][:, ::-1]
    width = math.sqrt(2 * (1 - cosine)) / fine
    apart = fine

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_matrix(b.column(2).to_pylist(), dims)) @ axes[:, :grid]
            cells = np.floor(u / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(cells[:, k]) for k in range(grid)]], ["id", "n", "v", *[f"g{k}" for k in range(grid)]])

    cells = [f"g{k}" for k in range(grid)]
    turned = entries.select("id", "n", "v").mapInArrow(turn, "id long, n long, v array<double>, " + ", ".join(f"{c} int" for c in cells))
    turned = saved(turned, "turned")
    n = turned.count()
    block_rows = min(block_rows, max(2048, -(-n // 8)))
    parts = max(1, -(-n // block_rows))
    ordered = turned.repartitionByRange(parts, *cells, "id").sortWithinPartitions(*cells, "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            at = (np.arange(b.num_rows) + k) // block_rows
            k += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.compute.add(pa.compute.multiply(b.column(b.num_columns - 1), 1 << 20), pa.array(at, pa.int64()))], [*b.schema.names[:-1], "block"])

    ordered = saved(ordered.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(blocks, "id long, n long, v array<double>, " + ", ".join(f"{c} int" for c in cells) + ", block long"), "ordered")

    ranges = min(parts, 2048)  # of neighbouring blocks; what is broadcast is bounded by their number

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for block, q in p.groupby("block"):
                u = _unit(_matrix(q.v, dims)) @ axes
                yield pd.DataFrame({"block": [block], "lo": [u.min(0)], "hi": [u.max(0)]})

    def joined_boxes(p: pd.DataFrame) -> pd.DataFrame:  # a block can span batches, a range has many blocks
        return pd.DataFrame({"k": [p.k.iloc[0]], "lo": [np.min(list(p.lo), axis=0)], "hi": [np.max(list(p.hi), axis=0)]})

    box = "k long, lo array<double>, hi array<double>"
    box_of = ordered.select("block", "v").mapInPandas(boxes, "block long, lo array<double>, hi array<double>")
    boxed = saved(box_of.withColumnRenamed("block", "k").groupBy("k").applyInPandas(joined_boxes, box), "boxes")
    box_of = boxed.withColumn("range", (F.shiftright("k", 20) * ranges / F.lit(parts)).cast("long"))
    wide = box_of.select(F.col("range").alias("k"), "lo", "hi").groupBy("k").applyInPandas(joined_boxes, box).orderBy("k").toPandas()
    eps2 = 2 * (1 - cosine) + 1e-9
    sent = spark.sparkContext.broadcast((wide.k.to_numpy(np.int64), _matrix(wide.lo, dims), _matrix(wide.hi, dims)))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lo, hi = sent.value
        for b in batches:
            for i in b.column(0).to_pylist():
                gap = np.maximum(0, np.maximum(lo - hi[i], lo[i] - hi))
                near = np.flatnonzero((gap * gap).sum(1) <= eps2)
                near = near[near >= i]
                yield pa.RecordBatch.from_arrays([pa.array(names[np.full(len(near), i)]), pa.array(names[near])], ["rx", "ry"])

    near = spark.range(len(wide)).mapInArrow(partners, "rx long, ry long")
    side = lambda n: box_of.select(F.col("range").alias(f"r{n}"), F.col("k").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"))
    near = near.join(side("x").hint("merge"), "rx").join(side("y").hint("merge"), "ry").filter("x <= y")
    gap = F.zip_with(F.zip_with("lo_x", "hi_y", lambda p, q: p - q), F.zip_with("lo_y", "hi_x", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    pairs = near.filter(F.aggregate(gap, F.lit(0.0), lambda t, g: t + g * g) <= eps2).select("x", "y")
    pairs = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    sides = ordered.hint("merge").join(pairs, "block")

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        def side(q: pd.DataFrame) -> tuple:
            q = q.sort_values([*cells, "id"])
            v = _matrix(q.v, dims)
            return q.id.to_numpy(), q.n.to_numpy(), v, _unit(v) @ axes, q[cells].to_numpy()

        x, y = p.x.iloc[0], p.y.iloc[0]
        a = side(p[p.block == x])
        b = None if x == y else side(p[p.block == y])
        na, nb, edges = join_blocks(a, b, cosine, apart)
        counts = pd.DataFrame({"a": a[0], "b": -1, "links": na + (nb if b is None else 0)})
        if b is not None:
            counts = pd.concat([counts, pd.DataFrame({"a": b[0], "b": -1, "links": nb})])
        counts = counts[counts.links > 0]
        return pd.concat([counts, pd.DataFrame({"a": [e[0] for e in edges], "b": [e[1] for e in edges], "links": 0}, dtype="int64")])

    schema = "a long, b long, links long"
    found = saved(sides.groupBy("x", "y").applyInPandas(joined, schema), "found")
    dropped(turned, ordered, boxed)
    return found


def _unit(m: np.ndarray) -> np.ndarray:
    big = np.abs(m).max(axis=1, keepdims=True)  # so that squares of huge or tiny components neither overflow nor vanish
    m = m / big
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))
