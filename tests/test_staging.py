import pytest

from weftline.streaming.staging import StagingLog, shed, watch


def test_log_states_replay_and_compaction(spark, tmp_path):
    log = StagingLog(spark, str(tmp_path / "log"))
    events = lambda *x: spark.createDataFrame([(p, k, h) for p, k, h in x], "path string, kind string, content_hash string")
    assert log.state().count() == 0
    log.append(events(("a", "created", "1"), ("b", "created", "2")), "2024-01-01 00:00:01")
    log.append(events(("a", "modified", "3")), "2024-01-01 00:00:02")
    assert sorted((r["lsn"], r["status"]) for r in log.state().collect()) == [(1, "pending"), (2, "pending"), (3, "pending")]
    seen = []

    def broken(batch):
        raise ValueError("no")

    with pytest.raises(ValueError):
        log.replay(broken, "2024-01-01 00:00:03")
    assert {r["status"] for r in log.state().collect()} == {"failed"}
    log.transition("pending", "2024-01-01 00:00:04", "status = 'failed'")
    log.transition("applying", "2024-01-01 00:00:05", "lsn = 1")
    log.recover("2024-01-01 00:00:06")
    assert {r["status"] for r in log.state().collect()} == {"pending"}
    log.replay(lambda batch: seen.extend(tuple(r) for r in batch.orderBy("path").collect()), "2024-01-01 00:00:07")
    assert seen == [("a", 3, "modified", "3"), ("b", 2, "created", "2")]
    assert {r["status"] for r in log.state().collect()} == {"applied"}
    log.transition("pending", "2024-01-01 00:00:08")  # applied ones stay
    log.compact()
    assert log.state().count() == 1
    log.append(events(("c", "created", "9")), "2024-01-01 00:00:09")
    assert sorted((r["lsn"], r["status"]) for r in log.state().collect()) == [(3, "applied"), (4, "pending")]


def test_watch_and_back_pressure(spark, tmp_path):
    folder = tmp_path / "tree" / "sub"
    folder.mkdir(parents=True)
    for name in ("a.py", "b.rs", "c.txt"):
        (folder / name).write_text(name)
    stream = watch(spark, str(tmp_path / "tree"), ("py", "rs"), max_files=1)
    query = stream.writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("watched").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["a.py", "b.rs"] and query.lastProgress["batchId"] >= 1
    batch = spark.createDataFrame([(1, 10), (2, 20)], "id long, size long")
    assert shed(batch, 0, 0)[1] is False
    assert shed(batch, 9_999, 0)[1] and shed(batch, 0, 256 << 20)[0].count() == 0


def test_changes_of_equal_time(spark, tmp_path):
    log = StagingLog(spark, str(tmp_path / "log"), patience=0)
    event = spark.createDataFrame([("a", "created", "1")], "path string, kind string, content_hash string")
    now = "2024-01-01 00:00:00"
    log.append(event, now)
    status = lambda: {r["lsn"]: r["status"] for r in log.state().collect()}
    log.transition("applying", now)
    log.recover(now)
    assert status() == {1: "pending"}
    for to in ("applying", "failed", "pending", "applying", "applied"):
        log.transition(to, now)
        assert status() == {1: to}


def test_two_writers_and_dead_ones(spark, tmp_path):
    a, b = (StagingLog(spark, str(tmp_path / "log"), patience=p) for p in (60, 0))
    events = lambda p: spark.createDataFrame([(p, "created", "1")], "path string, kind string, content_hash string")
    now = "2024-01-01 00:00:00"
    a.append(events("x"), now)
    dead = a._claim()  # claims a number, writes nothing
    b.append(events("y"), now)  # does not wait for it
    with pytest.raises(RuntimeError):  # comes back to life
        a._write(dead, a.state())
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: StagingLog(spark, str(tmp_path / "log")).append(events(f"t{i}"), now), range(3)))
    rows = a.state().collect()
    assert sorted(r["lsn"] for r in rows) == [1, 2, 3, 4, 5] and {r["path"] for r in rows} == {"x", "y", "t0", "t1", "t2"}
