import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
FAST = ["stats_global", "evo_hotspots", "cov_entity", "finding_stats", "diff_branches", "stab_narrowest", "mod_coupling", "text_issues", "vec_topk"]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["caller", "first_line", "calls"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    found = QUERIES[name](spark, DATA)
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    want = sorted((tuple(map(plain, x)) for x in result.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in columns) for x in found.collect()), key=str) == want
