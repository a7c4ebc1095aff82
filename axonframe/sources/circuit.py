"""A stored circuit: four tables in one folder, in place of one binary file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("neurons", "edges", "groups", "meta")


def write_circuit(path: str, neurons: DataFrame, edges: DataFrame, groups: DataFrame, meta: dict[str, str]) -> None:
    """``neurons`` (``id``, ...), ``edges`` (``pre, post, w``, ...), ``groups`` (``name, id``) and a few facts as Parquet.

    Edges without ``plastic`` and ``base_w`` get them: not plastic, and the weight itself.
    """
    extra = {"plastic": F.lit(False), "base_w": F.col("w")}
    edges = edges.withColumns({c: v for c, v in extra.items() if c not in edges.columns})
    facts = neurons.sparkSession.createDataFrame(sorted((k, str(v)) for k, v in meta.items()), "key string, value string")
    for name, df in zip(TABLES, (neurons, edges, groups, facts.coalesce(1)), strict=True):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_circuit(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


#: Fixed values of the binary circuit format: its tag before the version, groups by version, and counts in the header.
TAG = "FLYMIND"
GROUPS = (("sugar", 1), ("motor", 1), ("odor", 1), ("self_motion", 2), ("cx", 3), ("visual_relay", 4))
POPULATION_COUNTS = {1: 11, 2: 11, 3: 12, 4: 12}
NEURON = [("id", "<i8"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("population", "u1"), ("family", "u1"), ("pad", "<u2")]
MOST_EDGES = 8_000_000


def _parsed(content: bytes) -> dict[str, dict[str, object]]:
    """Columns of the three tables of one binary circuit, as arrays."""
    import numpy as np

    tag = content[:8].decode("ascii", "replace")
    if not (tag.startswith(TAG) and tag[7:] in "1234" and tag[7:]):
        raise ValueError(f"no circuit file: {tag!r}")
    version, at = int(tag[7:]), 8

    def take(kind: object, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    n, synapses, _ = map(int, take("<u4", 3))
    take("<u4", POPULATION_COUNTS[version])
    names = [g for g, since in GROUPS if version >= since]
    sizes = [int(k) for k in take("<u4", len(names))]
    cells = take(np.dtype(NEURON), n)
    offsets = take("<i4", n + 1)
    columns = {"post": take("<i4", synapses), "w": take("<f4", synapses), "plastic": take("u1", synapses) != 0, "base_w": take("<f4", synapses)}
    members = [take("<i4", k) for k in sizes]
    return {
        "neurons": {"index": np.arange(n), **{c: cells[c].copy() for c, _ in NEURON[:-1]}},
        "edges": {"pre": np.repeat(np.arange(n), np.diff(offsets)), **columns},
        "groups": {"name": np.repeat(names, sizes), "index": np.concatenate([np.zeros(0, "<i4"), *members])},
    }


SCHEMAS = {"neurons": "index long, id long, x float, y float, z float, population int, family int", "edges": "pre long, post long, w float, plastic boolean, base_w float", "groups": "name string, index long"}


def read_blob(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A binary circuit of version 1 to 4 as the tables ``neurons``, ``edges`` and ``groups``; parsed where it is read, a reduced graph a file."""
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")

    def part(name: str) -> object:
        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                for content in b.content:
                    p = pd.DataFrame(_parsed(content)[name])
                    for k in range(0, len(p), 200_000):
                        yield p.iloc[k : k + 200_000]

        return run

    return {name: files.mapInPandas(part(name), schema) for name, schema in SCHEMAS.items()}


def write_blob(path: str, neurons: DataFrame, edges: DataFrame, groups: DataFrame, version: int = 4, most_edges: int = MOST_EDGES) -> None:
    """The tables of :func:`read_blob` as one binary file of a version. A circuit is a reduced graph; one of over ``most_edges`` is refused, as it is put together in one place."""
    import numpy as np

    if (size := edges.count()) > most_edges:
        raise ValueError(f"{size} edges are too many for one file (at most {most_edges})")
    n = neurons.orderBy("index").toPandas()
    e = edges.orderBy("pre", "post", "w").toPandas()
    g = groups.orderBy("name", "index").toPandas()
    names = [name for name, since in GROUPS if version >= since]
    members = [g["index"][g.name == name].to_numpy("<i4") for name in names]
    cells = np.zeros(len(n), np.dtype(NEURON))
    for c, _ in NEURON[:-1]:
        cells[c] = n[c]
    counts = np.bincount(n.population.to_numpy(int), minlength=POPULATION_COUNTS[version])[: POPULATION_COUNTS[version]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(e.pre.to_numpy(int), minlength=len(n)))])
    parts = [np.array([len(n), len(e), 0, *counts, *map(len, members)], "<u4"), cells, offsets.astype("<i4"), e.post.to_numpy("<i4"), e.w.to_numpy("<f4"), e.plastic.to_numpy("u1"), e.base_w.to_numpy("<f4"), *members]
    with open(path, "wb") as f:
        f.write(f"{TAG}{version}".encode())
        for x in parts:
            f.write(x.tobytes())
