import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.streaming import events as e
from weftline.streaming import publish


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


ROWS = [("a", at(0), "created"), ("a", at(0.1), "modified"), ("b", at(0.2), "removed"), ("b", at(0.3), "created"), ("c", at(0.4), "created"), ("c", at(0.45), "removed"), ("z", at(100), "modified")]
WANT = {("a", "created", 2), ("b", "modified", 2), ("c", "removed", 2)}


def run_stream(spark, tmp_path, rows, schema, transform, name, mode="append"):
    source = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def test_coalesce_stream_is_the_batch(spark, tmp_path):
    schema = "path string, ts timestamp, kind string"
    batch = e.coalesce_batch(spark.createDataFrame(ROWS[:6], schema), "path", ["ts"], "kind")
    assert {tuple(r) for r in batch.collect()} == WANT
    cancelled = e.coalesce_batch(spark.createDataFrame(ROWS[:6], schema), "path", ["ts"], "kind", "scheduler")
    assert {tuple(r) for r in cancelled.collect()} == {x for x in WANT if x[0] != "c"}
    parts = [ROWS[:3], ROWS[3:6], ROWS[6:], [("z", at(200), "modified")]]
    got = run_stream(spark, tmp_path, parts, schema, lambda s: e.coalesce_stream(s.withWatermark("ts", "1 second"), "path", "ts", "kind"), "coalesced")
    assert {x for x in got if x[0] != "z"} == WANT


def test_hash_diff_stream_is_the_batch(spark, tmp_path):
    schema = "path string, ts timestamp, hash string"
    rows = [("a", at(i), h) for i, h in enumerate("xxyyx")] + [("b", at(9), "q")]
    batch = {(r["path"], r["hash"], r["change"]) for r in e.hash_diff(spark.createDataFrame(rows, schema), "path", ["ts"], "hash").collect()}
    got = run_stream(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]], schema, lambda s: e.hash_diff_stream(s, "path", "ts", "hash"), "hashed")
    assert set(got) == batch and len(got) == 4


def test_debounce_and_storm(spark):
    rows = spark.createDataFrame([(i, at(s)) for i, s in enumerate([0, 0.2, 0.4, 5, 5.3, 9])], "i int, ts timestamp")
    assert sorted(r["n"] for r in e.debounced(rows, "ts", "500 milliseconds").collect()) == [1, 2, 3]
    counts = {r["i"]: r["n"] for r in e.trailing_counts(rows, "ts", 5).collect()}
    assert counts == {0: 1, 1: 2, 2: 3, 3: 4, 4: 3, 5: 3}
    assert e.storms(rows, "ts", "2 seconds", "1 second", 3).where("n >= 3").count() >= 1
    assert e.rolling(rows, "ts", [], "i", "10 seconds").first()["n"] == 6


def test_trailing_counts_without_a_sliding_frame(spark):
    times = [at(s) for s in [0, 0, 4.999999, 5, 5, 5.000001, 10, 10.5, 14.999999, 15, 15.000001, 40]] + [None, None]
    rows = spark.createDataFrame(list(enumerate(times * 3)), "i int, ts timestamp")
    counted = e.trailing_counts(rows, "ts", 5)
    assert counted.columns == ["i", "ts", "n"]
    inside = lambda t, u: t is None and u is None or t is not None and u is not None and 0 <= (t - u).total_seconds() <= 5
    assert {r["i"]: r["n"] for r in counted.collect()} == {i: sum(inside(t, u) for u in times * 3) for i, t in enumerate(times * 3)}
    # A frame that slides is counted anew for each row: no cell of a few thousand times takes long.
    many = spark.range(60_000).selectExpr("id", "timestamp_micros(1704067200000000 + id * 10) as ts")
    assert e.trailing_counts(many, "ts", 3600).where("n <> id + 1").count() == 0
    assert "specifiedwindowframe(RangeFrame" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_guard(spark):
    rows = spark.createDataFrame([("s", 1, 1, 1), ("s", 2, 1, 1), ("s", 3, 1, 0), ("s", 4, 2, 0), ("t", 5, 0, 9)], "session string, arrival int, epoch int, seq int")
    assert [r["verdict"] for r in e.generation_guard(rows, "session", "arrival").orderBy("arrival").collect()] == ["accept", "duplicate", "stale", "accept", "accept"]


def test_publish(spark, tmp_path):
    folder = str(tmp_path / "generations")
    put = publish.publisher(folder, "k", ["v"], "gone")
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, gone boolean")
    put(make(("a", 1, False), ("a", 2, False), ("b", 1, False)), 0)
    put(make(("b", 2, True), ("c", 1, False)), 1)
    put(make(("b", 2, True), ("c", 1, False)), 1)  # again: the same generation
    assert publish.generations(spark, folder) == [1, 2]
    assert sorted(tuple(r)[:2] for r in publish.current(spark, folder).collect()) == [("a", 2), ("c", 1)]
    assert publish.drop_old(spark, folder, 1) == [1]
    assert publish.current(spark, folder).where(F.col("k") == "a").count() == 1


GUARDED = [
    ("a", 1, "seen", 1, 1), ("a", 2, "seen", 1, 2), ("a", 3, "commit", 1, 1), ("a", 4, "commit", 1, 2), ("a", 5, "commit", 1, 2), ("a", 6, "seen", 1, 2),
    ("b", 7, "commit", 1, 1), ("b", 8, "seen", 3, 0), ("a", 9, "seen", 0, 9), ("a", 10, "seen", 2, 0), ("a", 11, "commit", 1, 2), ("a", 12, "commit", 2, 0), ("b", 13, "seen", 2, 9),
]
VERDICTS = ["accept", "accept", "stale", "commit", "commit", "duplicate", "stale", "accept", "stale", "accept", "stale", "commit", "stale"]


def test_two_phases_over_restarts(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "path string, arrival long, phase string, epoch long, seq long"
    batch = e.two_phase_guard(spark.createDataFrame(GUARDED, schema), "path", "arrival").orderBy("arrival").collect()
    assert [r["verdict"] for r in batch] == VERDICTS
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k, part in enumerate((GUARDED[:2], GUARDED[2:7], GUARDED[7:])):  # a start each, on one checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        guarded = e.two_phase_guard_stream(stream, "path", "arrival").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        guarded.start(sink).awaitTermination()
    found = spark.read.parquet(sink).orderBy("arrival").collect()
    assert [r["verdict"] for r in found] == VERDICTS and [r["arrival"] for r in found] == list(range(1, 14))


def test_latest_wins_stream_is_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "path string, ts timestamp, v int, note string"
    rows = [("a", at(0), 1, None), ("a", at(0.2), 2, "x"), ("b", at(0.3), 3, "y"), ("a", at(5), 4, None), ("a", at(5.1), 5, "z"), ("a", at(5.2), 6, "w"), ("a", at(5.3), 7, "u"), ("b", at(9), 8, None)]
    want = {tuple(r) for r in e.latest_wins(spark.createDataFrame(rows, schema), "path", "ts", 500, 3).collect()}
    assert {(r[0], r[1], r[2], r[4]) for r in want} == {("a", 2, "quiet", 2), ("b", 1, "quiet", 3), ("a", 3, "number", 6), ("a", 1, "quiet", 7), ("b", 1, "quiet", 8)}
    parts = [rows[:2], rows[2:5], rows[5:], [("z", at(100), 0, None)], [("z", at(200), 0, None)]]
    got = run_stream(spark, tmp_path, parts, schema, lambda s: e.latest_wins_stream(s.withWatermark("ts", "0 seconds"), "path", "ts", 500, 3), "latest")
    assert {x for x in got if x[0] != "z"} == want


def test_removals_in_hash_diff(spark, tmp_path):
    schema = "path string, ts timestamp, hash string"
    rows = [("a", at(i), h) for i, h in enumerate(["x", None, None, "x", "y", None])] + [("b", at(9), None)]
    batch = [(r["path"], r["hash"], r["change"]) for r in e.hash_diff(spark.createDataFrame(rows, schema), "path", ["ts"], "hash").orderBy("ts").collect()]
    assert batch == [("a", "x", "added"), ("a", None, "removed"), ("a", "x", "added"), ("a", "y", "modified"), ("a", None, "removed")]
    got = run_stream(spark, tmp_path, [rows[:2], rows[2:]], schema, lambda s: e.hash_diff_stream(s, "path", "ts", "hash"), "removals")
    assert sorted(got, key=str) == sorted(batch, key=str)
