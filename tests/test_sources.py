import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonframe.operators import labels as L
from axonframe.sources import tables as T


def test_trials_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# a note\n# k,1\narm,trial,a,b\nx,1,1.5,NaN\ny,2,,oops\n")
    rows = T.read_trials(spark, str(tmp_path / "t.csv")).collect()
    assert rows[0].a == 1.5 and np.isnan(rows[0].b)
    assert rows[1].a is None and rows[1].b is None


def test_positional_tsv_with_short_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\tname\tv\n1\ta\t2.5\n2\tb\nx\tc\tz\n")
    rows = T.read_positional(spark, str(tmp_path / "t.tsv"), [("id", "long"), ("name", "string"), ("v", "double")]).collect()
    assert [tuple(r) for r in rows] == [(1, "a", 2.5), (2, "b", None), (None, "c", None)]


def test_edge_records(spark, tmp_path):
    a = np.array([(1, 2, 3), (4, 5, -6)], dtype=T.EDGE_RECORD)
    (tmp_path / "e.bin").write_bytes(np.int64(2).tobytes() + a.tobytes())
    assert [tuple(r) for r in T.read_edge_records(spark, str(tmp_path / "e.bin")).collect()] == [(1, 2, 3), (4, 5, -6)]


def test_feather_keeps_nulls_and_dictionaries(spark, tmp_path):
    t = pa.table({"id": pa.array([1, None, 3], pa.int64()), "kind": pa.array(["a", "b", None]).dictionary_encode(), "xyz": pa.array([[1.0, 2.0], None, []], pa.list_(pa.float32()))})
    with pa.OSFile(str(tmp_path / "t.feather"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=2)
    rows = T.read_feather(spark, str(tmp_path / "t.feather")).collect()
    assert [(r.id, r.kind, r.xyz) for r in rows] == [(1, "a", [1.0, 2.0]), (None, "b", None), (3, None, [])]
    assert T.read_feather(spark, str(tmp_path / "t.feather"), ["kind"]).columns == ["kind"]


def test_write_once_and_merge(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    T.write_once(df, f"{tmp_path}/p")
    T.write_once(df.union(df), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
    T.write_once(df.union(df), f"{tmp_path}/p", overwrite=True)
    assert T.read_parquet(spark, f"{tmp_path}/p", ["x"]).count() == 2
    T.write_csv(df, f"{tmp_path}/c", {"x": "a number"})
    assert "| x | y |" in T.markdown(df) and "| 1 | a |" in T.markdown(df)


def test_labels(spark):
    df = spark.createDataFrame([("EPG ring", None), (None, None), ("other", "delta7")], "a string, b string").withColumn("l", L.joined_label(["a", "b"]))
    assert [r.l for r in df.collect()] == ["EPG ring | ", " | ", "other | delta7"]
    code = L.first_match("l", [("epg", 1), ("ring|delta", 2)], 9)
    assert [r[0] for r in df.select(code).collect()] == [1, 9, 2]
    assert df.select(L.substituted("a", [("EPG", "x"), ("x ring", "y")])).first()[0] == "y"
    p = spark.createDataFrame([("1,2.5,x",), ("",), (None,)], "t string").select(*L.parsed_point("t", 2.0))
    assert [tuple(r) for r in p.collect()] == [(2.0, 5.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_text_encodings(spark, tmp_path):
    for n, b in (("a", b"\xef\xbb\xbfh\xc3\xa9"), ("b", "h\xe9".encode("utf-16")), ("c", b"h\xff")):
        (tmp_path / n).write_bytes(b)
    assert {r.path[-1]: r.text for r in T.read_text(spark, str(tmp_path)).collect()} == {"a": "h\xe9", "b": "h\xe9", "c": "h\ufffd"}


def test_log_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 2.5), ("y", 2, None)], "arm string, trial int, v double")
    for _ in range(2):
        T.append_log(df, f"{tmp_path}/log")
    assert T.read_piped_log(spark, f"{tmp_path}/log", [("arm", "string"), ("trial", "int"), ("v", "double")]).count() == 4
    T.write_summary(df, f"{tmp_path}/s", {"cells": 5})
    assert [tuple(r) for r in T.read_trials(spark, f"{tmp_path}/s").collect()] == [("x", 1, 2.5), ("y", 2, None)]


@pytest.mark.parametrize("x", [0.0, 3.5, -3.5, 100.0])
def test_wrapped_angle(spark, x):
    from axonframe.functions.exprs import wrap_angle

    got = spark.range(1).select(wrap_angle(F.lit(x))).first()[0]
    assert -np.pi < got <= np.pi and np.isclose(np.cos(got), np.cos(x)) and np.isclose(np.sin(got), np.sin(x))


def test_edge_records_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = []
    for name, n in (("a.bin", 0), ("b.bin", 7), ("c.bin", 1000)):
        a = np.zeros(n, dtype=T.EDGE_RECORD)
        a["pre"], a["post"], a["weight"] = rng.integers(0, 1 << 60, n), rng.integers(-5, 5, n), rng.integers(-9, 9, n)
        (tmp_path / name).write_bytes(np.int64(n).tobytes() + a.tobytes())
        want += a.tolist()
    df = T.read_edge_records(spark, str(tmp_path), rows=100)
    assert df.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, df.collect())) == sorted(want)
    (tmp_path / "d.bin").write_bytes(np.int64(9).tobytes() + b"x" * 20)
    with pytest.raises(Exception, match="ends before"):
        T.read_edge_records(spark, str(tmp_path)).count()


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_circuit_blob(spark, tmp_path, version):
    from axonframe.sources import circuit as C

    rng = np.random.default_rng(version)
    cells = [(k, 1000 + k, float(k), -1.5, 0.0, k % 11, k % 5) for k in range(20)]
    edges = [(int(a), int(b), float(w), bool(p), float(w) / 2) for a, b, w, p in zip(rng.integers(0, 20, 90), rng.integers(0, 20, 90), rng.integers(-8, 8, 90), rng.integers(0, 2, 90), strict=True)]
    groups = [(g, int(k)) for g, _ in C.GROUPS for k in rng.choice(20, 3, replace=False)]
    make = lambda rows, name: spark.createDataFrame(rows, C.SCHEMAS[name])
    path = str(tmp_path / "c.bin")
    C.write_blob(path, make(cells, "neurons"), make(edges, "edges"), make(groups, "groups"), version)
    got = C.read_blob(spark, path)
    assert sorted(map(tuple, got["neurons"].collect())) == cells
    assert sorted(map(tuple, got["edges"].collect())) == sorted(edges)
    assert sorted(map(tuple, got["groups"].collect())) == sorted(g for g in groups if version >= dict(C.GROUPS)[g[0]])
    with pytest.raises(ValueError, match="too many"):
        C.write_blob(path, make(cells, "neurons"), make(edges, "edges"), make(groups, "groups"), version, most_edges=5)


def test_circuit_blob_by_its_layout(spark, tmp_path):
    """Two cells and one synapse, byte by byte, as version 1 has them."""
    import struct

    from axonframe.sources import circuit as C

    cell = lambda i, x, pop: struct.pack("<qfffBBH", i, x, 0.0, 0.0, pop, 0, 0)
    content = b"FLYMIND1" + struct.pack("<3I", 2, 1, 0) + struct.pack("<11I", *[0] * 11) + struct.pack("<3I", 1, 0, 0)
    content += cell(7, 1.5, 3) + cell(8, 2.5, 6) + struct.pack("<3i", 0, 0, 1) + struct.pack("<i", 0) + struct.pack("<f", -2.0) + b"\x01" + struct.pack("<f", -1.0) + struct.pack("<i", 1)
    (tmp_path / "x.bin").write_bytes(content)
    got = C.read_blob(spark, str(tmp_path / "x.bin"))
    assert [tuple(r) for r in got["neurons"].orderBy("index").collect()] == [(0, 7, 1.5, 0.0, 0.0, 3, 0), (1, 8, 2.5, 0.0, 0.0, 6, 0)]
    assert [tuple(r) for r in got["edges"].collect()] == [(1, 0, -2.0, True, -1.0)]
    assert [tuple(r) for r in got["groups"].collect()] == [("sugar", 1)]


def test_summary_quotes_cells(spark, tmp_path):
    rows = [('a,"b"', 1.5, None), ("plain", 2.5, "line\nend"), ("# x", 3.5, "")]
    df = spark.createDataFrame(rows, "arm string, value double, note string")
    T.write_summary(df, f"{tmp_path}/s", {"k": 1})
    got = T.read_trials(spark, f"{tmp_path}/s", {"arm": "string", "note": "string"}).collect()
    assert sorted((r.arm, r.value, r.note or "") for r in got) == sorted((a, v, n or "") for a, v, n in rows)


def test_markdown_is_never_cut(spark):
    assert T.markdown(spark.range(3)).count("\n") == 4
    with pytest.raises(ValueError, match="over 2 rows"):
        T.markdown(spark.range(3), most=2)
