import os

from pyspark.sql import functions as F

import corpus_pipeline as cp
from test_jaccard_join import brute as brute_links
from test_line_dedup import brute as brute_lines
from weftline.llm.queries import tokenizer_path
from test_packing import check

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 150")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(kept["language"]) >= 140
    want = brute_lines(kept["language"])
    assert dict(kept["lines"]) == {d: want[d] for d, t in kept["language"] if want[d] or not t}
    links = brute_links(kept["lines"])
    assert sorted(d for d, _ in kept["near_copies"]) == sorted(d for d, n, c, _ in links if d == c or not n)
    text = dict(kept["near_copies"])
    assert all(text[d] == t for d, t in kept["mixture"])
    assert 1.2 <= sum(len(t.split()) for _, t in kept["mixture"]) / sum(len(t.split()) for t in text.values()) <= 1.8
    last = cp.STAGES[-1][1](spark, docs, DATA)
    whole = docs.select(F.length("text")).count()
    assert last.where("start = 0").count() == whole


def test_near_copies_of_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(49)]
    edited = [*words[:24], "x", *words[25:]]  # 40 of 50 five-word shingles, 42 of 50 four-word ones
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join([*words[:23], "x", "y", *words[25:]]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in cp.near_copies(spark, docs.where("doc_id < 3"), DATA).collect()] == [1]
    assert sorted(r["doc_id"] for r in cp.near_copies(spark, docs.where("doc_id in (1, 3)"), DATA).collect()) == [1, 3]


def test_packed_tokens(spark):
    from weftline.llm.packing import pack_documents

    docs = [(1, "a b c"), (2, "d " * 5000)]
    total, padding = check(docs, pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path()).collect())
    assert padding == 0 and total == 5005


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs_out = stage(spark, docs, DATA)
        assert docs_out.count() == 0


ODD = [
    (1, "the house that was there and with this thing " * 12, "en", "s1"), (1, "another text with the same number as the one before it " * 9, "en", "s1"), (None, "a text of nobody in particular that was there " * 8, "en", None),
    (None, "a second text of nobody that has other words in it " * 8, "en", None), (2, "", "en", "s2"), (3, None, None, "s2"), (4, "12 34 !!", None, "s2"), (5, "the house that was there and with this thing " * 12, "en", "s1"),
    (5, "the house that was there and with this thing " * 12, "en", "s1"),
]
CLASHES = ["lang_pred", "score", "spans", "n_lines", "n_removed", "size", "source_size", "target", "copies", "taken", "key", "row", "did", "doc", "id", "_id", "_hash", "src", "rank", "start", "ids"]


def odd_docs(spark):
    rows = [(*r, len(r[1] or ""), *[i * 100 + k for k in range(len(CLASHES))]) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES))


def marks(rows):
    """Which rows of ODD are there; checks that the other columns came through."""
    found = []
    for r in rows:
        i = r["lang_pred"] // 100
        assert [r[c] for c in CLASHES] == [i * 100 + k for k in range(len(CLASHES))] and (r["doc_id"], r["lang"], r["source"]) == (ODD[i][0], *ODD[i][2:])
        found.append(i)
    return sorted(found)


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_docs(spark)
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept[name] = marks(out.collect())
    assert kept["language"] == [0, 1, 2, 3, 7, 8]  # null, empty and letterless texts go
    assert kept["lines"] == [0, 1, 2, 3, 4, 5, 6]  # a repeated text is gone but for its first place
    assert kept["near_copies"] == [0, 1, 2, 3, 4, 5, 6]  # one of the equal texts, all without copies, all without words
    assert set(kept["mixture"]) <= set(range(9))
    pieces = cp.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(ODD)


def test_very_long_text(spark):
    words = [f"the house number {i} was there" for i in range(30_000)]
    docs = spark.createDataFrame([(1, "\n".join(words), "en", "a", 0), (2, "\n".join(words[:20_000]), "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, DATA).count() == (1 if name == "lines" else 2) or name == "mixture"


def test_pipeline_query(spark):
    """run() is its stages one after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = cp.run(spark, DATA)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    rows = out.select("doc_id", "start", "doc_tokens", "length").collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
