"""Queries over whole tables against their SQL, on a small fixture."""

import duckdb
import pytest

from weftline.catalog import ORACLE_SQL, QUERIES
from weftline.operators import vector

DATA = "/root/testdata/sf0.001"
NAMES = [
    "graph_orphans", "graph_layers", "graph_depth_histogram", "graph_topological", "graph_test_impact", "graph_shortest_cycle", "graph_local_delta", "vec_similar", "resolve_cascade",
    "interval_overlap", "stab_narrowest", "stab_first", "dependency_providers", "attribution", "delta_resolve", "graph_vulnerability", "tree_rollup", "symbol_detail", "suffix_match",
]
FIXTURE = {
    "lineitem": "select * replace (l_partkey % 50 as l_partkey) from t where l_orderkey < 150",
    "part": "select * from t where p_partkey < 60",
}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("small"), duckdb.connect()
    for name in ("lineitem", "part", "orders", "customer", "supplier", "events", "embeddings"):
        rows = FIXTURE.get(name, "select * from t").replace("from t", f"from '{DATA}/{name}.parquet'")
        con.execute(f"copy ({rows}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con, str(folder)


def fetched(con, sql):
    result = con.execute(sql)
    return [c[0] for c in result.description], sorted((tuple(r) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, small, name):
    con, folder = small
    columns, want = fetched(con, ORACLE_SQL[name])
    found = QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert sorted((tuple(x[c] for c in columns) for x in found.collect()), key=str) == want
    assert want or name == "graph_orphans"


def test_blocks_of_queries(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small[1]}/embeddings.parquet")
    asked = rows.where("vec_id % 7 = 0")
    want = sorted(tuple(r) for r in vector.similar(rows, asked, 3, 0.0).collect())
    monkeypatch.setattr(vector, "BLOCK", 4)
    found = vector.similar(rows, asked, 3, 0.0)
    assert sorted(tuple(r) for r in found.collect()) == want and len({r[0] for r in want}) > 4
