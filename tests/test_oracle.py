"""Every registered query runs; those with SQL give the same rows."""

import math

import pytest

import __spark_entry__

SLOW = ("pipeline", "op")


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def close(a, b):
    return len(a) == len(b) and all(x == y or all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if not n.startswith(SLOW)])
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck("0.001").execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close(rows(got), rows(want))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 25


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
