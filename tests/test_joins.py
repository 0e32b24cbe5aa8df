import random

from weftline.operators import joins as j


def test_stabbing_against_model(spark):
    rng = random.Random(1)
    spans = [(f"f{rng.randrange(3)}", i, s := rng.randrange(600), s + rng.randrange(300)) for i in range(80)]
    points = [(f"f{rng.randrange(4)}", line) for line in rng.sample(range(900), 120)]
    intervals = spark.createDataFrame(spans, "file string, id long, start_line int, end_line int")
    frame = spark.createDataFrame(points, "file string, line int")
    hold = lambda f, x: [s for s in spans if s[0] == f and s[2] <= x <= s[3]]
    narrow = {(r["file"], r["line"]): r["id"] for r in j.stab_narrowest(frame, intervals, ["file"], width=64).collect()}
    assert narrow == {(f, x): min(hold(f, x), key=lambda s: (s[3] - s[2], s[2], s[1]))[1] for f, x in points if hold(f, x)}
    first = {(r["file"], r["line"]): r["id"] for r in j.stab_first(frame, intervals, ["file"], width=64).collect()}
    assert first == {(f, x): min(hold(f, x), key=lambda s: (s[2], s[1]))[1] for f, x in points if hold(f, x)}
    hunks = [(f, n, x, x + rng.randrange(200)) for n, (f, x) in enumerate(points)]
    met = j.overlaps(spark.createDataFrame(hunks, "file string, hunk long, from_line int, to_line int"), intervals, ["file"], width=64)
    want = sorted((n, s[1]) for f, n, a, b in hunks for s in spans if s[0] == f and s[2] <= b and s[3] >= a)
    assert sorted((r["hunk"], r["id"]) for r in met.collect()) == want


def test_cascade(spark):
    calls = spark.createDataFrame([(1, "m", "f"), (2, "n", "g"), (3, "n", "zz"), (4, "q", "f")], "call int, module string, name string")
    names = spark.createDataFrame([(10, "m", "f"), (11, "n", "f"), (12, "x", "g")], "id long, module string, name string")
    found = j.cascade(calls, [("exact", j.unique_by(names, ["module", "name"]), ["module", "name"]), ("unique", j.unique_by(names, ["name"]), ["name"])])
    got = {r["call"]: (r["callee_id"], r["method"]) for r in found.collect()}
    assert got == {1: (10, "exact"), 2: (12, "unique"), 3: (0, "unresolved"), 4: (0, "unresolved")}


def test_rules(spark):
    paths = spark.createDataFrame([("src/a.py",), ("docs/x.md",), ("src/gen/b.py",), ("keep.log",), ("x.log",)], "path string")
    rules = spark.createDataFrame([(1, "", "all"), (2, j.glob_to_regex("/src/"), "dev"), (3, j.glob_to_regex("**/gen/*.py"), "bot")], "idx int, pattern string, owner string")
    assert [r["owner"] for r in j.last_rule(paths, rules).collect()] == ["dev", "all", "bot", "all", "all"]
    ignored = [r["ignored"] for r in j.is_ignored(paths, ["*.log", "!keep.log", "# no", "gen/"]).collect()]
    assert ignored == [False, False, True, False, True]


def test_suffix_and_lookahead(spark):
    files = spark.createDataFrame([(1, "a/b/c.py"), (2, "c.py"), (3, "x/bc.py")], "id long, file string")
    paths = spark.createDataFrame([("b/c.py",), ("root/a/b/c.py",), ("bc.py",), ("none.py",)], "path string")
    assert {r["path"]: r["id"] for r in j.suffix_match(paths, files).collect()} == {"b/c.py": 1, "root/a/b/c.py": 1, "bc.py": 3}
    changes = spark.createDataFrame([("k", v) for v in (1, 2, 5, 9, 12)], "key string, v int")
    finds = spark.createDataFrame([("k", 9, "x"), ("k", 12, "x"), ("k", 1, "y")], "key string, v int, finding string")
    got = [tuple(r) for r in j.lookahead(changes, finds, "key", "v", 2).collect()]
    assert got == [("k", "x", 2)]
