import os

import duckdb
import pytest

from siftwell import catalog

DATA = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[c] for c in columns) for r in got.collect()) == order(want.fetchall())


def test_lookups_reach_the_scan(spark):
    at = catalog.index(spark, DATA, "docs")
    hits, _ = at.search_batch([(0, "thanedble", 0, 10, False)], snippets=False)
    plan = hits._jdf.queryExecution().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "title_tf" in line]
    assert scans and all("term,thanedble" in s for s in scans)
    assert all("positions" not in s for s in scans)  # no phrase, no second word: positions aren't read
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_entry(spark):
    import __spark_entry__

    assert {"query_id", "rank", "doc_id", "url", "score", "matched", "title", "snippet"} == set(__spark_entry__.entry(spark).columns)
