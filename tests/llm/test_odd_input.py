"""Cases that rows of a crawl have: bytes that are no text, clashing names and types, very long texts."""

import pytest

from weftline.llm import ann, chat, lang_id, packing, quality_classifier, quality_rules
from weftline.llm.jaccard_join import drop_near_copies
from weftline.llm.queries import tokenizer_path, url_rules
from weftline.llm.url_filters import judge_urls

BROKEN = "cast(X'ff41' as string)"


@pytest.fixture(scope="module")
def docs(spark):
    plain = " ".join(f"word{i % 50} stands here." for i in range(40_000))  # 800,000 characters
    return spark.sql(f"select 1L as doc_id, {BROKEN} as text, 'en' as lang union all select 2L, 'A plain text.', 'en' union all select 3L, '{plain}', 'de' union all select null, null, null")


def test_broken_bytes_and_long_texts(spark, docs):
    model = lang_id.fit(docs)
    assert {r["doc_id"]: r["lang_pred"] is not None for r in lang_id.identify(docs, model).collect()} == {1: True, 2: True, 3: True, None: True}
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    scores = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert len(scores) == 4 and all(0 <= r["score"] <= 1 for r in scores)
    pieces = packing.pack_documents(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 3, None} and sum(r["length"] for r in pieces if r["doc_id"] == 3) > 100_000
    found = {r["doc_id"]: r for r in quality_rules.clean_lines(docs).collect()}
    assert found[1]["word_chars"] == 2 and found[3]["n_words"] == 120_000


def test_chat_with_broken_bytes_and_long_texts(spark):
    turns = spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, {BROKEN} as text union all select 1L, 1L, 'assistant', repeat('long <| text ', 50000)")
    row = chat.read_back(chat.format_conversations(turns)).first()
    assert row["n_turns"] == 2 and row["loss_chars"] == 650_000


def test_false_declaration_of_a_concatenation():
    def numbered(turns):
        return "".join(f"{i}:{t}|" for i, (_, t) in enumerate(turns))

    numbered.concatenates = True
    turns = [("user", f"t{i}") for i in range(5)]
    out, spans = chat.locate(turns, numbered)
    assert out == numbered(turns) and [out[s[3] : s[4]] for s in spans] == [t for _, t in turns]


def test_clashing_names_and_types(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", 9, {"k": 1}, 7), (1, "http://a.com/", 9, {"k": 1}, 7)], "page_id long, url string, _best int, _host map<string, int>, _page int")
    found = judge_urls(pages, url_rules(spark)).collect()
    assert len(found) == 2 and found[0]["_best"] == 9 and found[0]["_host"] == {"k": 1} and found[0]["rule"] == "com/"
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, {"a": 1}, "x"), (2, text, {"b": 2}, "y"), (2, text, {"b": 2}, "y"), (None, text, None, None), (3, "other words", {"a": 1}, "z")]
    near = spark.createDataFrame(rows, "doc_id long, text string, key map<string, int>, component string")
    assert sorted(r["doc_id"] for r in drop_near_copies(near).collect()) == [1, 3]


def test_very_large_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [1e-200, 1e-200]), (50, [1e200, 1e199])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(ann.build_index(vectors), vectors.where("vec_id = 50")).orderBy("rank").collect()
    assert [{r["vec_id"] for r in found[:2]}, {r["vec_id"] for r in found[2:]}] == [{0, 2}, {1, 3}]
    assert all(abs(r["score"] - s) < 1e-12 for r, s in zip(found, (1 / 1.01**0.5, 1 / 1.01**0.5, 1.1 / 2.02**0.5, 1.1 / 2.02**0.5), strict=True))
