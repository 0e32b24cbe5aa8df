import os

import pytest

from weftline.streaming.build import DerivedTables, SourceBuild, tree_facts

FILES = {
    "a.py": "import b\n\ndef start():\n    b.help()\n    local()\n\ndef local():\n    other()\n",
    "b.py": "def help():\n    shared()\n\ndef only():\n    pass\n",
    "sub/c.py": "class Box:\n    def shared(self):\n        only()\n\ndef other():\n    missing()\n",
    "notes.txt": "no source",
}
TABLES = ("symbols", "calls", "imports", "edges")


def contents(tables):
    found = {n: sorted(map(repr, tables.table(n).collect())) for n in TABLES}
    return found | {"files": sorted(map(repr, tables.files().collect()))}


def write(tree, files):
    for name, text in files.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)


def answers(build):
    return {(os.path.basename(r["file"]), r["name"]): (os.path.basename(r["callee_file"]), r["method"]) for r in build.tables.table("edges").collect()}


def generation(build, table, gen):
    return build.spark.read.parquet(f"{build.folder}/tables/gen-{gen:09d}/{table}")


def test_edits_equal_a_full_build(spark, tmp_path):
    tree = tmp_path / "tree"
    write(tree, FILES)
    now = "2024-01-01 00:00:00"
    build = SourceBuild(spark, str(tree), str(tmp_path / "out"), buckets=4)
    build.refresh(now)
    assert answers(build)["a.py", "help"] == ("b.py", "exact") and answers(build)["c.py", "missing"] == ("", "unresolved")
    edits = [
        {"sub/c.py": FILES["sub/c.py"] + "\ndef missing():\n    start()\n"},  # a name comes
        # One goes that another file calls; a file comes, one goes.
        {"b.py": "def help():\n    local()\n", "d.py": "def local():\n    help()\n", "a.py": None},
    ]
    for edit in edits:
        write(tree, {n: t for n, t in edit.items() if t is not None})
        for n in (n for n, t in edit.items() if t is None):
            (tree / n).unlink()
        build.refresh(now)
    full = SourceBuild(spark, str(tree), str(tmp_path / "full"), buckets=3)
    full.refresh(now)
    assert contents(build.tables) == contents(full.tables)
    assert answers(build)["c.py", "only"] == ("", "unresolved") and answers(build)["b.py", "local"] == ("d.py", "unique")
    # The first edit took one file's facts, and of other files' calls those of its new name.
    assert {os.path.basename(r["path"]) for r in generation(build, "symbols", 2).collect()} == {"c.py"}
    assert {os.path.basename(r["file"]) for r in generation(build, "edges", 2).collect()} == {"c.py"}
    assert {(os.path.basename(r["file"]), r["name"]) for r in generation(build, "edges", 3).collect()} >= {("c.py", "only")}
    before = contents(build.tables)
    build.tables.compact()
    assert contents(build.tables) == before and len(build.tables.generations()) == 1
    build.refresh(now)  # nothing has changed
    assert len(build.tables.generations()) == 1


def test_other_files_are_not_read(spark, tmp_path):
    tree = tmp_path / "tree"
    write(tree, FILES)
    build = SourceBuild(spark, str(tree), str(tmp_path / "out"), buckets=2)
    build.refresh("2024-01-01 00:00:00")
    other = tree / "b.py"
    times, text = other.stat(), other.read_text()
    other.write_text(text.replace("only", "ONLY"))  # as long, and with the old time
    os.utime(other, ns=(times.st_atime_ns, times.st_mtime_ns))
    write(tree, {"a.py": "def start():\n    only()\n"})
    build.refresh("2024-01-01 00:00:00")
    assert answers(build)["a.py", "only"] == ("b.py", "unique")


def test_crashes(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    write(tree, {"a.py": FILES["a.py"], "b.py": FILES["b.py"]})
    now = "2024-01-01 00:00:00"
    build = SourceBuild(spark, str(tree), str(tmp_path / "out"), buckets=2, patience=0)
    publish, transition = build.tables._publish, build.log.transition

    def broken(*_, **__):
        raise OSError("gone")

    monkeypatch.setattr(build.tables, "_publish", broken)
    with pytest.raises(OSError):
        build.refresh(now)
    assert {r["status"] for r in build.log.state().collect()} == {"failed"} and build.tables.generations() == []
    monkeypatch.setattr(build.tables, "_publish", publish)
    monkeypatch.setattr(build.log, "transition", lambda to, *a: broken() if to == "applied" else transition(to, *a))
    with pytest.raises(OSError):
        build.refresh(now)  # published, but not marked
    assert {r["status"] for r in build.log.state().collect()} == {"applying"}
    monkeypatch.setattr(build.log, "transition", transition)
    build.refresh(now)
    assert {r["status"] for r in build.log.state().collect()} == {"applied"} and build.tables.generations() == [1]
    assert {r["method"] for r in build.tables.table("edges").collect()} == {"exact", "unique", "unresolved"}


def test_only_buckets_of_changed_names_are_read(spark, tmp_path):
    tables = DerivedTables(spark, str(tmp_path / "t"), buckets=16)
    facts = spark.createDataFrame([("f.py", "symbol", n, n, "function", i, i) for i, n in enumerate(["x", "y", "z"])], "path string, fact string, scope string, name string, kind string, start_line int, end_line int")
    tables.apply(spark.createDataFrame([("f.py", "1")], "path string, hash string"), spark.createDataFrame([], "path string"), lambda _: tree_facts(facts))
    plan = tables._current("symbols", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket" in plan.split("PartitionFilters")[1]
