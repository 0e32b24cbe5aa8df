import pyarrow as pa

from weftline.operators import trigram
from weftline.operators.trigram import TrigramIndex, query_grams


def test_index_equals_the_scan(spark, tmp_path):
    texts = {i: f"{'alpha' if i % 2 else 'Beta'} word{i % 7} {'gamma' if i % 5 == 0 else 'é'} common" for i in range(60)} | {60: None, 61: ""}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, body string")
    index = TrigramIndex(spark, str(tmp_path / "index"), buckets=8)
    index.add(frame({k: t for k, t in texts.items() if k < 40}), "id", "body")
    index.add(frame({k: t for k, t in texts.items() if k >= 40}), "id", "body")
    changed = {3: "alpha now without", 8: "BETA word99 gamma"}
    index.add(frame(changed), "id", "body")
    index.remove(frame({5: "", 10: "", 99: ""}), "id")
    now = {k: t for k, t in (texts | changed).items() if k not in (5, 10)}
    scan = lambda q: sorted(k for k, t in now.items() if t is not None and all(w in t.lower() for w in q.lower().split()))

    def check():
        for q in ("Alpha", "gamma common", "word99", "ph al"):
            found = index.search(q, frame(texts | changed), "id", "body").collect()
            assert sorted(r["id"] for r in found) == scan(q), q

    check()
    assert len(index.generations()) == 4
    index.compact()
    assert len(index.generations()) == 1
    check()


def test_only_the_buckets_of_the_grams_are_read(spark, tmp_path):
    index = TrigramIndex(spark, str(tmp_path / "index"), buckets=64)
    index.add(spark.createDataFrame([(i, f"text number {i * 7919}") for i in range(50)], "id long, body string"), "id", "body")
    grams = query_grams("number")
    plan = index.postings(grams)._jdf.queryExecution().executedPlan()
    scan = plan.toString()
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in scan.split("PushedFilters: [")[1]
    read = {f.split("bucket=")[1].split("/")[0] for f in index.postings(grams).inputFiles()}
    assert index.postings(grams).select("gram").distinct().count() == len(grams)
    assert len({r["bucket"] for r in index.postings(grams).select("bucket").collect()}) <= len(grams) < len(read)
    assert query_grams("a bc") == []


def test_postings_are_lists_by_slices(monkeypatch):
    texts = {7: "abcabc", 3: "ab", 9: "", 4: "zabc é\U0001f600x\n", 5: "abc" * 40, 6: "\U0001f600x\n"} | {100 + i: chr(0x4E00 + i) + "bca" for i in range(200)}
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(texts.values())], ["key", "text"])
    want = sorted({(t[i : i + 3], k) for k, t in texts.items() for i in range(len(t) - 2)})
    for size, rows in ((1 << 20, len({g for g, _ in want})), (50, None), (1, len(want))):
        monkeypatch.setattr(trigram, "SLICE", size)
        lists = [r for b in trigram.gram_lists(iter([batch])) for r in b.to_pylist()]
        assert sorted((r["gram"], k) for r in lists for k in r["keys"]) == want and all(r["n"] == len(r["keys"]) for r in lists)
        assert rows is None or len(lists) == rows
