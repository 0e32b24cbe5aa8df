import json

from weftline.sources import code, sinks


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_reports(spark, tmp_path):
    path = write(tmp_path, "x.info", "TN:\nSF:a.py\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.py\nDA:7,1\nend_of_record\n")
    assert rows(code.lcov(spark, path), "file", "line") == [("a.py", 1, 2), ("a.py", 2, 0), ("b.py", 7, 1)]
    path = write(tmp_path, "c.xml", '<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="3"/><line number="4" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert rows(code.cobertura(spark, path), "line") == [("a.py", 1, 3), ("a.py", 4, 0)]
    path = write(tmp_path, "j.xml", '<testsuite><testcase name="a" classname="T" time="0.5"/><testcase name="b" classname="T" time="1"><failure message="no">x</failure></testcase><testcase name="c" classname="T" time="0"><skipped message="later"/></testcase></testsuite>')
    assert [r[:4] for r in rows(code.junit(spark, path), "test")] == [("a", "T", "passed", 500.0), ("b", "T", "failed", 1000.0), ("c", "T", "skipped", 0.0)]
    path = write(tmp_path, "log", "commit:abc\tAnn\t100\n\n3\t1\ta.py\n-\t-\tbin\ncommit:def\tBob\t200\n\n1\t0\ta.py\n")
    assert rows(code.git_log(spark, path), "ts", "file") == [("abc", "Ann", 100.0, "a.py", 3, 1), ("abc", "Ann", 100.0, "bin", 0, 0), ("def", "Bob", 200.0, "a.py", 1, 0)]
    path = write(tmp_path, "s.json", json.dumps({"results": [{"check_id": "r", "path": "a.py", "start": {"line": 3}, "end": {"line": 4}, "extra": {"severity": "ERROR", "message": "m"}}]}))
    assert rows(code.semgrep(spark, path), "rule") == [("r", "a.py", 3, 4, "ERROR", "m")]


def test_builds(spark, tmp_path):
    path = write(tmp_path, "cc.json", json.dumps([{"directory": "/", "file": "a.c", "command": "cc -DX=1 -Iinc -Wall -c a.c"}, {"directory": "/", "file": "b.c", "arguments": ["cc", "-DY", "-Iinc", "-O2"]}]))
    found = code.compile_commands(spark, path).first()
    assert tuple(found) == (["X=1", "Y"], ["inc"], ["-O2", "-Wall"])
    path = write(tmp_path, "Makefile", "CC := gcc\nall: a.o b.o\n\tcc a\nFLAGS += -O\n")
    assert rows(code.makefile(spark, path), "kind", "name") == [("target", "all", "a.o b.o"), ("variable", "CC", "gcc"), ("variable", "FLAGS", "-O")]
    path = write(tmp_path, "Makefile.long", "SRC = a.c \\\n\tb.c\nall: a.o \\\n  b.o\n")
    assert rows(code.makefile(spark, path), "kind", "name") == [("target", "all", "a.o b.o"), ("variable", "SRC", "a.c b.c")]
    path = write(tmp_path, "OWNERS", "# c\n* @all\n/src/ @dev @x\n")
    assert [r[2] for r in rows(code.codeowners(spark, path), "idx")] == ["@all", "@dev @x"]
    path = write(tmp_path, "d.patch", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -9 +10 @@\n-z\n+y\n")
    assert rows(code.unified_diff(spark, path), "from_line") == [("x.py", 1, 3, 1, 0), ("x.py", 10, 10, 1, 1)]


def test_parse(spark, tmp_path):
    write(tmp_path, "t/a.py", "import os\nclass C:\n    def m(self):\n        return helper(os.getcwd())\n\ndef helper(x):\n    return x\n")
    write(tmp_path, "t/sub/b.go", 'import "fmt"\nfunc main() {\n\tfmt.Println(add(1))\n}\n')
    write(tmp_path, "t/skip.txt", "def no(): pass")
    files = code.source_tree(spark, str(tmp_path / "t"))
    facts = [tuple(r)[3:] for r in code.parse_tree(files).collect()]
    assert {("symbol", "C", "C", "class", 2, 4), ("symbol", "C.m", "m", "method", 3, 4), ("symbol", "helper", "helper", "function", 6, 7)} <= set(facts)
    assert ("call", "C.m", "helper", "call", 4, 4) in facts and ("import", "", "os", "import", 1, 1) in facts
    assert ("symbol", "main", "main", "function", 2, 5) in facts and ("call", "main", "fmt.Println", "call", 3, 3) in facts


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    make = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    sinks.upsert(make(("a", 1), ("b", 1)), path, ["k"])
    sinks.upsert(make(("b", 2), ("b", 3), ("c", 1)), path, ["k"], ["v"])
    assert rows(spark.read.parquet(path), "k") == [("a", 1), ("b", 3), ("c", 1)]
    sinks.insert_ignore(make(("a", 9), ("d", 4)), path, ["k"])
    assert rows(spark.read.parquet(path), "k")[0] == ("a", 1) and spark.read.parquet(path).count() == 4
    parts = str(tmp_path / "parts")
    sinks.replace_partitions(make(("a", 1), ("b", 1)), parts, "k")
    sinks.replace_partitions(make(("b", 7)), parts, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(parts).collect()) == [("a", 1), ("b", 7)]


def test_text_sinks(spark):
    edges = spark.createDataFrame([("a::x", "b", 2)], "src_module string, dst_module string, calls long")
    assert [r[0] for r in sinks.mermaid(edges).collect()] == ["graph LR", "  a__x -->|2| b"]
    assert [r[0] for r in sinks.dot(edges).collect()] == ["digraph g {", '  "a::x" -> "b" [label=2];', "}"]
    found = spark.createDataFrame([("r", "ERROR", 'say "x"', "a.py", 1, 2)], "rule string, severity string, message string, file string, start_line int, end_line int")
    document = json.loads(sinks.sarif(found, "t").first()[0])
    assert document["runs"][0]["results"][0]["level"] == "error"
    assert document["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 2}
    samples = spark.createDataFrame([("x", 'q"', 3.5)], "a string, b string, v double")
    assert [r[0] for r in sinks.prometheus(samples, "m", "gauge", ["a", "b"], "v").collect()] == ["# TYPE m gauge", 'm{a="x",b="q\\""} 3.5']
