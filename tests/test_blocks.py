from weftline.operators.blocks import block_spans, with_block_ends
from weftline.sources.code import parse_tree

RUST = '''struct Point { x: i32 }
fn outer<'a>(s: &'a str) -> i32 {
    // } not a brace
    let t = "{ also { not";
    fn inner() { helper('{') }
    if s.len() > 1 {
        return 1;
    }
    0
}
trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { String::new() }
}
fn last() {
'''
JAVA = '''class A {
    /* void no() { } */
    int one() { return 1; }
    void two(int a,
             int b) throws Exception {
        for (int i = 0; i < a; i++) { one(); }
        while (a > 0) {
            a--;
        }
    }
    abstract void none();
    class B { void deep() { two(1, 2); } }
}
'''
SCRIPT = "function f({a, b}, c = '}') {\n  return `{` + a;\n}\nfunction g() { return 1 }\n"


def test_spans(spark):
    rows = [("r", RUST, "rust"), ("j", JAVA, "java"), ("s", SCRIPT, "javascript"), ("n", None, "go"), ("e", "", "go")]
    found = {tuple(r) for r in block_spans(spark.createDataFrame(rows, "k string, body string, lang string"), "k", "body", "lang").collect()}
    assert found == {
        ("r", "Point", 0, 1, 1), ("r", "outer", 0, 2, 10), ("r", "inner", 1, 5, 5), ("r", "Shape", 0, 11, 14), ("r", "name", 1, 13, 13), ("r", "last", 0, 15, 16),
        ("j", "A", 0, 1, 13), ("j", "one", 1, 3, 3), ("j", "two", 1, 4, 10), ("j", "B", 1, 12, 12), ("j", "deep", 2, 12, 12),
        ("s", "f", 0, 1, 3), ("s", "g", 0, 4, 4),
    }


def test_symbols_end_where_their_blocks_do(spark):
    files = spark.createDataFrame([("a.go", "go", "h", "func outer() {\n  x := func() { y() }\n}\n\nvar z = 1\n\nfunc next() {}\n")], "path string, language string, hash string, content string")
    facts = parse_tree(files)
    ends = {r["name"]: r["end_line"] for r in with_block_ends(facts, files).where("fact = 'symbol'").collect()}
    assert ends == {"outer": 3, "next": 7}
    assert with_block_ends(facts, files).count() == facts.count()
