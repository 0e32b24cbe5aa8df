import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import histograms as h
from weftline.sources.sinks import prometheus_histogram

BOUNDS = (1.0, 2.0, 5.0)


def test_parts_add_up_to_the_whole(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(0, 7), 1.0, 2.0, 5.0]) for _ in range(400)]
    rows = spark.createDataFrame([(f"l{i % 2}", i % 7, v) for i, v in enumerate(values)] + [("l0", 0, None), ("l1", 0, float("nan"))], "label string, part int, v double")
    whole = h.observe(rows, "v", "label", bounds=BOUNDS).orderBy("label").collect()
    merged = h.merge(h.observe(rows, "v", "label", "part", bounds=BOUNDS), "label", bounds=BOUNDS).orderBy("label").collect()
    for w, m, own in zip(whole, merged, (values[::2], values[1::2]), strict=True):
        assert w["counts"] == m["counts"] == [sum(bisect.bisect_left(BOUNDS, v) == k for v in own) for k in range(4)]
        assert w["n"] == m["n"] == len(own) and abs(w["total"] - sum(own)) < 1e-9 > abs(m["total"] - sum(own))
    found = h.observe(rows, "v", "label", bounds=BOUNDS).select("label", *[h.percentile(p, BOUNDS).alias(f"p{k}") for k, p in enumerate((0.1, 0.5, 0.9))]).orderBy("label").collect()
    for r, own in zip(found, (sorted(values[::2]), sorted(values[1::2])), strict=True):
        for k, p in enumerate((0.1, 0.5, 0.9)):
            true = own[max(0, -(-len(own) * int(p * 10) // 10) - 1)]
            at = bisect.bisect_left(BOUNDS, true)
            assert r[f"p{k}"] == 5.0 if at == 3 else abs(r[f"p{k}"] - true) <= BOUNDS[at] - (BOUNDS[at - 1] if at else 0)
    none = h.observe(rows.limit(0).withColumn("label", F.lit("x")), "v", bounds=BOUNDS)
    assert none.select("n", h.percentile(0.5, BOUNDS).alias("p")).first() == (0, None)
    with pytest.raises(ValueError):
        h.observe(rows, "v", bounds=(2.0, 1.0))


def test_exposition(spark):
    rows = spark.createDataFrame([('q"\\\n', 0.5), ('q"\\\n', 3.0), ('q"\\\n', 9.0)], "a string, v double")
    lines = [r[0] for r in prometheus_histogram(h.observe(rows, "v", "a", bounds=BOUNDS), "m", ["a"], BOUNDS).collect()]
    own = 'a="q\\"\\\\\\n"'
    assert lines == ["# TYPE m histogram", *[f'm_bucket{{{own},le="{le}"}} {n}' for le, n in (("1.0", 1), ("2.0", 1), ("5.0", 2), ("+Inf", 3))], f"m_sum{{{own}}} 12.5", f"m_count{{{own}}} 3"]


def test_stream_in_update_mode(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[(at(1), 0.5), (at(2), 3.0)], [(at(3), 1.5), (at(70), 9.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    counted = h.observe(stream.withWatermark("ts", "1 minute"), "v", F.window("ts", "1 minute").alias("w"), bounds=BOUNDS)
    last = {}

    def keep(batch, _):
        last.update({r["w"]["start"]: (r["counts"], r["total"], r["n"]) for r in batch.collect()})

    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert last == {at(0): ([1, 1, 1, 0], 5.0, 3), at(60): ([0, 0, 0, 1], 9.0, 1)}
