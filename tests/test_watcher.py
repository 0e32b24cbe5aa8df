import os

from weftline.streaming.events import hash_diff
from weftline.streaming.watcher import FolderWatch, as_hashes, with_renames


def test_created_modified_removed_renamed(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    watch = FolderWatch(spark, str(tree), str(tmp_path / "out"), ("py", "rs"))
    time = lambda s: f"2024-01-01 00:00:{s:02d}"
    steps = []
    for name, text in (("a.py", "one"), ("b.py", "two"), ("b2.py", "two"), ("c.txt", "other")):
        (tree / name).write_text(text)
    watch.scan(time(0))
    (tree / "a.py").write_text("one, longer")
    (tree / "b.py").rename(tree / "moved.py")
    os.utime(tree / "b2.py", (1, 1))  # a new time only
    watch.scan(time(10))
    (tree / "b2.py").unlink()
    watch.scan(time(20))
    (tree / "late.rs").write_text("two")  # too late for a rename
    watch.scan(time(30))
    (tree / "moved.py").unlink()
    watch.scan(time(40))
    for s in (50, 59):  # time goes on
        (tree / f"tick{s}.py").write_text(str(s))
        watch.scan(time(s))
        steps.append(s)
    want = {("created", "a.py", None), ("created", "b.py", None), ("created", "b2.py", None), ("modified", "a.py", None), ("renamed", "moved.py", "b.py"), ("removed", "b2.py", None), ("created", "late.rs", None), ("removed", "moved.py", None)}
    name = lambda p: p and os.path.basename(p)
    shown = lambda rows: {(r["kind"], name(r["path"]), name(r["from_path"])) for r in rows if "tick" not in r["path"]}
    assert shown(with_renames(watch.events(stream=False)).collect()) == want
    query = with_renames(watch.events()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "sink"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "sink"))
    assert shown(found.collect()) == want
    changes = [(name(r["path"]), r["change"]) for r in hash_diff(as_hashes(found), "path", ["at"], "content_hash").orderBy("at", "path").collect() if "tick" not in r["path"]]
    assert changes == [("a.py", "added"), ("b.py", "added"), ("b2.py", "added"), ("a.py", "modified"), ("b.py", "removed"), ("moved.py", "added"), ("b2.py", "removed"), ("late.rs", "added"), ("moved.py", "removed")]
