"""The registered queries over the smallest tables, against their SQL where they have any."""

import duckdb
import pytest

from assaylake.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows or name == "p10_found"
    if name not in SQL:
        return
    con = duckdb.connect()
    for t in ("fragments", "obs", "x_landscape", "regulatory_links", "documents", "mix_targets"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in cur.fetchall()) == sorted(tuple(str(r[n]) for n in names) for r in rows)
