import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["backtest_metrics", "wf_anchored", "macro_merge", "regime_transitions", "target_labels"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = sorted(x[0] for x in cur.description)
    order = [x[0] for x in cur.description]
    want = sorted((tuple(r[order.index(c)] for c in names) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=str) == want
