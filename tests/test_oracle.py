"""Every registered query with an oracle equals its DuckDB SQL at sf0.001."""

import math

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

SQL = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_registered_has_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 90


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert _canon(rows, df.columns) == _canon(drows, dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 4
    assert df.columns[0] == "segment"
