from pyspark.sql import functions as F

from weftline.operators import relational as r
from weftline.operators import text as t


def test_search_and_grep(spark):
    rows = spark.createDataFrame([(1, "Alpha_beta gamma"), (2, "alpha only"), (3, "50% 'quoted' \\ ünï")], "id int, body string")
    ids = lambda q: [x["id"] for x in t.search(rows, q, ["body"], 10, "id").collect()]
    assert ids("ALPHA gam") == [1] and ids("alpha") == [1, 2] and ids("'") == [3] and ids("%") == [3] and ids("ü") == [3]
    found = t.search_index(t.trigram_index(rows, "id", "body"), "alpha", "id")
    assert sorted(x["id"] for x in found.collect()) == [1, 2]
    grep = t.grep(spark.createDataFrame([(1, "a b\nb a\nab")], "id int, body string"), "id", "body", ["a", "b$"])
    assert [x["line"] for x in grep.collect()] == [1, 3]


def test_rules(spark):
    rows = spark.createDataFrame([(1, "x\nDROP TABLE t;\n"), (2, "try: x\nexcept: pass"), (3, "fine")], "id int, body string")
    found = t.guard(rows, "id", "body")
    assert {(x["id"], x["rule"], x["line"]) for x in found.collect()} == {(1, "GR-builtin-db-2", 2)}
    assert {tuple(x) for x in t.decide(found, "id").collect()} == {(1, "block")}
    code = spark.createDataFrame([("if a&&b and c: for x in y",), ("a && b",)], "c string")
    assert [x[0] for x in code.select(t.complexity(F.col("c"))).collect()] == [4, 1]
    sizes = spark.createDataFrame([(1, "name VARCHAR(80)", "name varchar (40)"), (2, "VARCHAR(8)", "VARCHAR(9)")], "id int, a string, b string")
    assert [tuple(x) for x in t.shrinks(sizes, "id", "a", "b").collect()] == [(1, 80, 40)]


def test_budget(spark):
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "id int, body string")
    got = t.budgeted(rows, "body", ["id"], 25).collect()
    assert [x["id"] for x in got] == [0, 1] and all(x["truncated"] for x in got)


def test_scores(spark):
    dates = spark.createDataFrame([("2024-01-01",), ("2023-01-01",), ("2023-01-02",), ("2024-12-31",)], "d string").withColumn("ts", F.to_timestamp("d"))
    assert [x[0] for x in dates.select(r.monday_week(F.col("ts"))).collect()] == [1, 0, 1, 53]
    counts = spark.createDataFrame([(20, 0, 0), (1, 1, 1), (0, 0, 0)], "high int, medium int, low int")
    assert [(x["score"], x["level"]) for x in r.health(counts).collect()] == [(0.0, "poor"), (92.5, "excellent"), (100.0, "excellent")]
    lines = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 0)], "entity int, line int, hits int")
    assert tuple(r.entity_coverage(lines).first()) == (1, 3, 1, 33.33, [1, 3])


def test_enclosing_symbol(spark):
    matches = spark.createDataFrame([("a", 2), ("a", 5), ("a", 9), ("b", 2)], "file string, line int")
    symbols = spark.createDataFrame([("a", 1, "class", 1, 6), ("a", 2, "method", 4, 5), ("b", 3, "function", 3, 4)], "file string, id int, kind string, start_line int, end_line int")
    found = {(r["file"], r["line"]): (r["symbol"], r["kind"]) for r in t.enclosing(matches, symbols).collect()}
    assert found == {("a", 2): (1, "class"), ("a", 5): (2, "method"), ("a", 9): (None, None), ("b", 2): (None, None)}
    assert [r["line"] for r in t.enclosing(matches, symbols, ["method"]).collect()] == [5]


def test_lines_of_many_matches_in_one_pass(spark):
    import re
    import time

    texts = {1: "x = 1\n" * 6000, 2: "a = \n\nb = x\n", 3: "= \n*= \n*", 4: "", 5: "none"}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    began = time.monotonic()
    got = t.guard(frame, "id", "text", (("r", "c", "warn", r"=\s+"),)).select("id", "line").collect()
    assert time.monotonic() - began < 20
    assert sorted(map(tuple, got)) == sorted((k, x.count("\n", 0, m.start()) + 1) for k, x in texts.items() for m in re.finditer(r"=\s+", x))
