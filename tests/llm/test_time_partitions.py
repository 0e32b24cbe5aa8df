import calendar
import hashlib
import os
import random
from datetime import date, datetime, timedelta
from zlib import crc32

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftline.llm.queries import click_moment, time_partitioned
from weftline.llm.time_partitions import fold, merge, time_files, trie_of

FIELDS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part int, bag map<string, int>"


def moment_of(row):
    k = crc32(b"" if row[0] is None else str(row[0]).encode()) % 128
    if row[1] is None:
        return None
    if k < 16:
        return row[1] - timedelta(days=(k + 6) ** 3)
    return datetime.combine(row[1].date() - timedelta(days=row[1].weekday()), datetime.min.time()) if k > 111 else row[1]


def layout_of(moments, limit):
    """Leaf name of every hour: siblings are recounted from all moments at every node."""
    known = [m for m in moments if m is not None]
    leaves = {}

    def split(path, span):
        runs, before = [], None
        for m in span:
            own = [x for x in known if (x.year, x.month, x.day, x.hour)[: len(path) + 1] == (*path, m)]
            if len(own) > limit and len(path) < 3:
                below = {0: range(1, 13), 1: range(1, calendar.monthrange(path[0] if path else 1, m if len(path) == 1 else 1)[1] + 1), 2: range(24)}[len(path)]
                split((*path, m), below)
                before = None
            elif len(own) > limit:
                runs.append([[m], len(own)])
                before = None
            elif before and before[1] + len(own) <= limit:
                before[0].append(m)
                before[1] += len(own)
            else:
                before = [[m], len(own)]
                runs.append(before)
        parents = "".join(f"{p:02d}/" for p in path)
        for ms, n in runs:
            if n:
                wide = 2 if path else 4
                leaves.update({(*path, m): f"{parents}{ms[0]:0{wide}d}-{ms[-1]:0{wide}d}" for m in ms})

    if known:
        split((), range(min(known).year, max(known).year + 1))
    return leaves


def naive_files(rows, limit):
    moments = [moment_of(r) for r in rows]
    leaves = layout_of(moments, limit)
    held = {}
    for row, m in zip(rows, moments, strict=True):
        name = "null" if m is None else next(leaves[p] for k in range(1, 5) if (p := (m.year, m.month, m.day, m.hour)[:k]) in leaves)
        held.setdefault(name, []).append(((m or datetime.min), (row[2] or datetime.min), -1 if row[0] is None else row[0], row))
    files = {}
    for name, own in held.items():
        own.sort(key=lambda x: (*x[:3], repr(x[3])))
        for k in range(0, len(own), limit):
            files[name, k // limit + 1] = [x[3] for x in own[k : k + limit]]
    return files


def some_rows(n, seed, late=0.1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(120 * 86400)) if rng.random() < 0.6 else datetime(2024, 2, 3, 4, rng.randrange(60))
        arrived = ts + timedelta(seconds=rng.randrange(60)) if rng.random() > late else datetime(2024, 5, 1) + timedelta(seconds=rng.randrange(10**6))
        rows.append((None if i % 97 == 0 else i, None if i % 11 == 0 else ts, None if i % 53 == 0 else arrived, f"l{i % 3}", i % 2, {"a": i % 4}))
    return rows + rows[: n // 10]


def check(spark, rows, late_rows_only=None):
    clicks = spark.createDataFrame(rows, FIELDS).repartition(3)
    limit = 1 + len(rows) // 500
    first = naive_files([r for r in rows if r[2] and r[2] < datetime(2024, 5, 1)], limit)
    last = naive_files(rows, limit)
    canon = lambda own: sorted(map(repr, own))
    found = time_partitioned(clicks).collect()
    assert len(found) == len(last)
    for r in found:
        own = last[r["leaf"], r["part"]]
        same = (r["leaf"], r["part"]) in first and canon(first[r["leaf"], r["part"]]) == canon(own)
        ids = ",".join("" if x[0] is None else str(x[0]) for x in own)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        new = sum(not (x[2] and x[2] < datetime(2024, 5, 1)) for x in own)
        assert (r["n_rows"], r["n_new"], r["rewritten"], r["columns"]) == (len(own), new, not same, "click_id,ts,arrived_at,leaf,part,bag")
        there = pq.ParquetFile(r["path"].removeprefix("file:"))
        assert there.schema_arrow.names == clicks.columns
        assert canon(tuple({**x, "bag": dict(x["bag"])}.values()) for x in there.read().to_pylist()) == canon(own)
    return found


def test_against_brute_force(spark):
    found = check(spark, some_rows(3000, 1))
    assert {r["rewritten"] for r in found} == {True, False}
    assert max(r["part"] for r in found) > 5 and any(r["leaf"] == "null" for r in found)
    assert any(r["leaf"].count("/") == 3 for r in found) and any("/" not in r["leaf"] for r in found)
    folder = found[0]["path"].rpartition("/leaf_=")[0].removeprefix("file:")
    left = [f"{d}/{x}" for d, _, names in os.walk(folder) for x in names if x.endswith(".parquet")]
    assert sorted(left) == sorted(r["path"].removeprefix("file:") for r in found)
    assert sum(len(names) == 0 and not dirs for _, dirs, names in os.walk(folder)) == 0


def test_few_rows(spark):
    assert check(spark, []) == []
    nulls = [(i, None, None, None, None, None) for i in range(7)]
    clicks = spark.createDataFrame(nulls, FIELDS)
    assert [(r["leaf"], r["n_rows"], r["n_new"]) for r in time_partitioned(clicks).collect()] == [("null", 1, 1)] * 7
    everything = check(spark, some_rows(400, 2, late=0))
    assert sum(r["n_new"] for r in everything) == sum(r[2] is None for r in some_rows(400, 2, late=0))


def test_moments(spark):
    rows = [r for r in some_rows(800, 3) if r[1]]
    clicks = spark.createDataFrame(rows, FIELDS)
    assert [r[0] for r in clicks.select(click_moment()).collect()] == [moment_of(r) for r in rows]


def test_tries():
    rng = random.Random(4)
    counts = [{rng.choice([None, *range(300_000, 400_000, 777)]): rng.randrange(1, 9) for _ in range(200)} for _ in range(3)]
    a, b, c = (trie_of(x) for x in counts)
    total = {k: sum(x.get(k, 0) for x in counts) for x in counts for k in x}
    assert merge(merge(trie_of(counts[0]), trie_of(counts[1])), c) == merge(a, merge(b, trie_of(counts[2]))) == trie_of(total)
    layout = fold(trie_of(total), 12)
    assert sum(x.rows for x in layout.leaves) == sum(total.values())
    first = date(1970, 1, 1) + timedelta(hours=min(k for k in total if k is not None))
    assert layout.leaves[0].name.startswith(str(first.year))


def test_refresh_after_a_crash(spark, tmp_path):
    rows = spark.createDataFrame(some_rows(300, 5), FIELDS)
    folder = str(tmp_path / "t")
    files = time_files(rows, folder, F.col("ts"), ["arrived_at", "click_id"], 40)
    assert files.rewrite(rows.where("click_id < 200")) == set()
    rows.withColumns({files.leaf: F.lit("2024-2024"), files.part: F.lit(1)}).limit(9).write.mode("append").partitionBy(files.leaf, files.part).parquet(folder)
    files.rewrite(rows)
    assert files.read().count() == rows.count()
    kept = files.rewrite(rows)
    assert len(kept) == files.digests("click_id", F.lit(False)).count() > 5
