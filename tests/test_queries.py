"""Every registered core query over the smallest tables, against its SQL where it has any."""

import math
import os

import duckdb
import pytest

from assaylake.queries import analysis, assay, facts, fragments

MODULES = (analysis, assay, facts, fragments)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


def plain(v):
    if isinstance(v, float) and v == v and not math.isinf(v):
        return round(v, 5) + 0.0
    return v


def key(row):
    return tuple(repr(v) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name not in SQL:
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(float(r[n])) if isinstance(r[n], (int, float)) and not isinstance(r[n], bool) else r[n] for n in names) for r in rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
