import re

from weftline.operators import lookups, resolve, text
from weftline.operators.joins import glob_to_regex
from weftline.operators.similarity import coefficients, fnv1a, fnv1a_column, minhash_estimate, minhashed, permuted


def test_strategies_of_calls(spark):
    symbols = spark.createDataFrame(
        [(1, "a.m.f", "f", "a/m.py"), (2, "b.m.f", "f", "b/m.py"), (3, "b.k.g", "g", "b/k.py"), (4, "t.aws_x.main", "aws_x.main", "main.tf"), (5, "r::n::h", "h", "r.rs"), (6, "q.n.h", "h", "q.py")],
        "id long, qualified string, name string, file string",
    )
    imports = spark.createDataFrame([("z.py", "mm", "root/b/m")], "file string, alias string, path string")
    externals = spark.createDataFrame([(7, "os.getcwd", "getcwd", "std"), (8, "re.match", "match", "std")], "id long, qualified string, name string, package string")
    asked = {
        ("z.py", "a.m", "f"): (1, "exact"), ("z.py", "mm", "f"): (2, "import"), ("z.py", "m", "f"): (1, "suffix"), ("z.py", "", "g"): (3, "unique"), ("b/m.py", "", "f"): (2, "same_file"),
        ("z.py", "r.n", "h"): (5, "parent"), ("z.py", "", "aws_x.main"): (4, "dotted"), ("z.py", "os", "getcwd"): (-7, "external"), ("z.py", "", "match"): (-8, "external"), ("z.py", "", "none"): (0, "unresolved"),
        ("z.py", "", "f"): (0, "unresolved"),
    }
    calls = spark.createDataFrame([*asked, *asked], "file string, module string, name string")
    found = {(r["file"], r["module"], r["name"]): (r["callee_id"], r["method"]) for r in resolve.resolve_calls(calls, symbols, imports, externals).collect()}
    assert found == asked


def test_tested_names(spark):
    names = ["testFoo", "test_Foo_bar", "foo_test", "a_b_c_test", "test_foo", "check", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", resolve.tested_names("n").alias("x")).collect()
    found = {r["n"]: r["x"] for r in rows}
    assert found["testFoo"] == ["foo"] and found["foo_test"] == ["foo"] and found["test_Foo_bar"] == ["foo_bar", "foo", "bar"]
    assert set(found["a_b_c_test"]) == {"a_b_c", "a", "a_b", "b_c", "c"} and not found["test_foo"] and not found["check"] and not found[""]


def test_confidence_of_imports(spark):
    symbols = spark.createDataFrame([(1, "w2", "f", "a.b.f"), (2, "w2", "g", "b.g"), (3, "w2", "h", "x.h"), (4, "w1", "f", "a.b.f")], "id long, workspace string, name string, qualified string")
    imports = spark.createDataFrame([(9, "w1", p) for p in ("a::b::f", "a.b.g", "q/h", "none")], "source long, workspace string, path string")
    assert sorted((r["target"], r["confidence"]) for r in resolve.resolve_imports(imports, symbols).collect()) == [(1, 0.95), (2, 0.85), (3, 0.7)]


def test_permutations_are_bijective_and_estimates_near(spark):
    assert all(a % 2 for a, _ in coefficients())
    a, b = coefficients()[5]
    xs = [0, 1, 2**16, 2**31, 2**32 - 1, 123456789]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(permuted(F.lit(a).cast("long"), F.col("x"), F.lit(b).cast("long"))).collect()]
    assert got == [(a * x + b) % 2**32 for x in xs]
    words = ["", "a", "foobar", "Ünï"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fnv1a_column(F.col("w"))).collect()] == [fnv1a(w) for w in words]
    sets = spark.createDataFrame([(1, [f"w{i}" for i in range(100)]), (2, [f"w{i}" for i in range(20, 120)])], "id long, items array<string>")
    one, two = [r["signature"] for r in minhashed(sets).orderBy("id").collect()]
    est = spark.createDataFrame([(one, two)], "a array<long>, b array<long>").select(minhash_estimate("a", "b")).first()[0]
    assert abs(est - 80 / 120) < 0.15


def test_globs():
    import re

    fits = lambda p, path: bool(re.search(glob_to_regex(p), path))
    assert fits("x/", "a/x/f") and not fits("x/", "a/x") and fits("*.py", "a/b.py") and not fits("/*.py", "a/b.py")
    assert fits(r"a\*b", "a*b") and not fits(r"a\*b", "axb") and fits("[a-c]x", "bx") and not fits("[!a-c]x", "bx") and fits("[!a-c]x", "dx")
    assert fits("a/**/b", "a/b") and fits("a/**/b", "a/x/y/b") and not fits("a/?", "a/bc")


def test_guards_and_blocks(spark):
    rows = [(1, "x\nALTER  TABLE t\n\nDROP\nTABLE a; drop column b\nvarchar(9) -> VARCHAR(10) VARCHAR(30) → VARCHAR ( 20 )"), (2, "fine"), (3, None)]
    found = text.guard(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert sorted((r["rule"][-4:], r["line"]) for r in found) == [("db-1", 2), ("db-2", 4), ("db-2", 5), ("db-3", 6)]
    code = "pub fn one(x: u8) { if a { b() } }\ndef two(a):\n    save.write(1)\n    return 1\n\ndef three():\n    log::x; try\n"
    blocks = text.function_blocks(spark.createDataFrame([(1, code), (2, "no function here")], "id long, body string"), "id", "body")
    assert sorted((r["id"], r["name"], r["start_line"]) for r in blocks.collect()) == [(1, "one", 1), (1, "three", 6), (1, "two", 2), (2, "<file>", 1)]
    missing = {(r["name"], r["rule"][-5:]) for r in text.readiness(blocks.where("id = 1"), ["name"], "body").collect()}
    assert missing == {("one", "inc-1"), ("one", "inc-2"), ("two", "inc-1"), ("two", "inc-2"), ("two", "inc-3")}


def test_layers_and_issues(spark):
    rows = [(1, "select x from users; update Items set; env::var('HOME') config.get(\"k\") @app.get(", "python", "my_handler"), (2, None, "go", "x")]
    frame = spark.createDataFrame(rows, "id long, body string, lang string, name string")
    found = sorted((r["layer"], r["item"]) for r in text.cross_layer(frame, "id", "body", "name").collect())
    assert found == [("api", "function_name_keyword"), ("api", "route_decorator"), ("config", "HOME"), ("config", "k"), ("db", "Items"), ("db", "users")]
    code = spark.createDataFrame([(1, "x.unwrap() // TODO 12345", "rust"), (2, "x.unwrap()", "python")], "id long, body string, lang string")
    assert sorted((r["id"], r["rule"]) for r in text.issues(code, "id", "body", "lang").collect()) == [(1, "magic_number"), (1, "todo_fixme"), (1, "unwrap_call")]


def test_blame_and_counts(spark):
    rows = spark.createDataFrame([("f", "b", "2024-01-02"), ("f", "a", "2024-01-02"), ("f", "c", "2024-01-01")], "file string, author string, ts string").selectExpr("file", "author", "cast(ts as timestamp) ts")
    assert [tuple(r) for r in lookups.blame_owners(rows, "file", "author", "ts").collect()] == [("f", "a", 0.3333)]
    assert {r["category"]: r["n"] for r in lookups.counts_by(rows, "author", ["a", "z"]).collect()} == {"a": 1, "z": 0}


def test_imports_by_distinct_paths(spark):
    """Many importers of a name that many have: as many joined rows as answers, not importers times definitions."""
    symbols = [(100 + i, f"w{i % 3}", "s", f"p{i % 5}.s") for i in range(60)] + [(1, "w2", "s", "far.p1.s"), (2, "w1", "", ""), (3, "w1", "s", "1.s")]
    imports = [(i, f"w{i % 2}", p) for i in range(40) for p in ("far.p1.s", "x/s", "", "p2.s")]
    got = resolve.resolve_imports(spark.createDataFrame(imports, "source long, workspace string, path string"), spark.createDataFrame(symbols, "id long, workspace string, name string, qualified string"))
    want = {}
    for source, own, path in imports:
        spelled, name = {path, path.replace("::", "."), path.replace("/", ".")}, re.split(r"\.|::|/", path)[-1]
        best = {}
        for i, w, n, q in symbols:
            c = 0.95 if q in spelled else (0.85 if path.endswith(q) else 0.7) if name and n == name else None
            if c and w != own:
                best[w] = max(best.get(w, (0, 0)), (c, -i))
        for w, (c, i) in best.items():
            want[source, w, -i] = max(want.get((source, w, -i), 0), c)
    assert {(r["source"], r["target_workspace"], r["target"]): r["confidence"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the answers of distinct paths


def test_tests_of_frequent_names(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CELL", 3)
    tests = [(i, ("testOne_two", "two_one_test", "check")[i % 3]) for i in range(30)]
    functions = [(100 + i, ("one", "two", "three")[i % 3]) for i in range(30)] + [(200, "one"), (200, "two")]
    calls = [(0, 100), (0, 102), (1, 200), (2, 5), (99, 100), (3, 0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    pairs = {(t, f): "name_convention" for t, n in tests for f, m in functions if n != "check" and m in ("one", "two")}
    want = pairs | {c: "direct_call" for c in calls if c[0] < 30 and c[1] > 0}
    for some in (functions, functions[:30]):
        got = resolve.test_relations(frame(tests), frame(some), spark.createDataFrame(calls, "src long, dst long"))
        ids = {f for f, _ in some}
        assert sorted((r["test"], r["tested"], r["method"]) for r in got.collect()) == sorted((*k, v) for k, v in want.items() if k[1] in ids or v == "direct_call")
    # No pair is shuffled: pairs of the single names are made last.
    assert not re.search(r"Aggregate \[test#\d+L, tested#", got._jdf.queryExecution().optimizedPlan().toString())


def shuffled_rows(spark):
    """The stages so far with the rows that each has written for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, *[getattr(store, f"stageList$default${i}")() for i in (4, 5)])
    return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_what_meets_by_a_name_is_shuffled_a_few_times_only(spark, monkeypatch):
    for name, value in {"CELL": 1, "PARTS": 4, "LOOKED": 2}.items():
        monkeypatch.setattr(resolve, name, value, raising=False)
    tests, functions = [(i, "two_test") for i in range(40)] + [(40, "one_two_test")], [(100 + i, "two") for i in range(40)]
    calls = [(0, 100 + i) for i in range(5)] + [(1, 101), (1, 102), (2, 103), (3, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    for more in ([], [(100, "one"), (None, "two")]):  # a function of two names, one without an id
        before = shuffled_rows(spark)
        got = resolve.test_relations(frame(tests), frame(functions + more), spark.createDataFrame(calls, "src long, dst long")).collect()
        called = [(*c, "direct_call") for c in calls]
        want = called + [(t, f, "name_convention") for t, _ in tests for f in {i for i, _ in functions + more} if (t, f) not in calls]
        assert sorted(((r["test"], r["tested"], r["method"]) for r in got), key=str) == sorted(want, key=str)
        assert max(n for stage, n in shuffled_rows(spark).items() if stage not in before) <= 8 * 41  # not 41 times 40


def test_calls_are_copied_to_no_executor(spark, tmp_path):
    rows = {
        "calls": spark.createDataFrame([("f", "m", "s1"), ("f", None, "s2"), ("f", "m", "gone")], "file string, module string, name string").coalesce(1),
        "symbols": spark.range(1, 5000).selectExpr("id", "concat('m.s', id) as qualified", "concat('s', id) as name", "'g' as file"),
    }
    for name, table in rows.items():  # tables with the sizes of files
        table.write.parquet(str(tmp_path / name))
    calls, symbols = (spark.read.parquet(str(tmp_path / name)) for name in rows)
    none = spark.createDataFrame([], "file string, alias string, path string"), spark.createDataFrame([], "id long, qualified string, name string, package string")
    found = resolve.resolve_calls(calls, symbols, *none)
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()  # calls are the left side of each join
    assert sorted(map(tuple, found.collect())) == [("f", "", "s2", 2, "g", "unique", True), ("f", "m", "gone", 0, "", "unresolved", False), ("f", "m", "s1", 1, "g", "exact", True)]
