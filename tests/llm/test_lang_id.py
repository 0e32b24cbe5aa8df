import itertools
import os
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import lang_id
from weftline.llm.common import fold

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cost(scores, labels, penalty):
    return sum(scores[t, x] for t, x in enumerate(labels)) - penalty * sum(a != b for a, b in itertools.pairwise(labels))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = -rng.random((rng.integers(1, 8), 3)).astype(np.float32) * rng.integers(1, 6)
        penalty = float(rng.random() * 3)
        best = max(cost(scores, x, penalty) for x in itertools.product(range(3), repeat=len(scores)))
        assert abs(cost(scores, lang_id.viterbi(scores, penalty).tolist(), penalty) - best) < 1e-5


def small_model():
    words = {"en": "the house that was there and with this thing", "fr": "le maison qui est avec pour une chose bien", "ru": "дом который был там"}
    rows = [(i, kind, code, 5 * n) for i, text in enumerate(words.values()) for kind, codes, often in lang_id.count([text]) for code, n in zip(codes.tolist(), often.tolist())]
    return lang_id.Model(list(words), np.array(rows, np.int64))


def slow(text, model, penalty=lang_id.SWITCH):
    """Word by word and run by run, with regular expressions."""
    chunks = re.findall(r"[^\x20\x09-\x0D]+", text)
    values, letters = [], []
    for chunk in chunks:
        value, n = np.zeros(len(model.languages), np.float32), 0
        for run in ["".join(g) for alpha, g in itertools.groupby(chunk, str.isalpha) if alpha]:
            value = value + model.score(lang_id.Runs([run]))[0]
            n += len(run)
        values.append(value)
        letters.append(n)
    if not sum(letters):
        return "und", 0.0, []
    labels = lang_id.viterbi(np.array(values), penalty).tolist()
    shares = [sum(n for n, x in zip(letters, labels) if x == k) for k in range(len(model.languages))]
    best = shares.index(max(shares))
    spans, at = [], 0
    for x, group in itertools.groupby(labels):
        n = len(list(group))
        spans.append((model.languages[x], at, n))
        at += n
    return model.languages[best], shares[best] / sum(letters), spans


def test_grams_of_a_run():
    one, two = lang_id.Runs(["Ab"]), lang_id.Runs(["x ab,AB ab1a"])
    assert len(one.grams()[0]) == 2 and two.n.tolist() == [1, 2, 2, 2, 1] and len(two.unique) == 3
    assert set(one.grams()[0].tolist()) < set(two.grams()[0].tolist())
    assert two.chunks.tolist() == [3] and two.chunk.tolist() == [0, 1, 1, 2, 2]


def test_against_word_by_word():
    model, rng = small_model(), np.random.default_rng(2)
    words = ["the", "House,", "MAISON", "qui", "дом", "that.", "x1y", "été", "%%%", "chose-bien", "was!", "Est", "estb", "quia", "漢字", "\u00a0", "½", "\x1c", "İx", "a" * 300]
    texts = ["", " \n", *("".join(w + rng.choice([" ", "\n", "\t "]) for w in rng.choice(words, rng.integers(0, 40))) for _ in range(150))]
    for text, (lang, share, spans) in zip(texts, lang_id.label(texts, model), strict=True):
        want = slow(text, model)
        assert (lang, spans) == (want[0], want[2]) and abs(share - want[1]) < 1e-9


def test_mixed_spans():
    model = small_model()
    text = " ".join(["the house that was there with this thing"] * 3 + ["le maison qui est avec pour une chose"] * 4 + ["дом был там"] * 3)
    ((lang, share, spans),) = lang_id.label([text], model)
    assert lang == "fr" and 0 < share < 1
    assert [(s[0], s[2]) for s in spans] == [("en", 24), ("fr", 32), ("ru", 9)]
    assert lang_id.label(["дом"], model)[0][0] == "ru"
    for text in ("", "123 !?", " \n", "² ½ ① Ⅷ"):  # numbers are no letters
        assert lang_id.label([text], model) == [("und", 0.0, [])]
    assert lang_id.label(["漢字"], model)[0][0] in ("en", "fr", "ru")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lang_id.fit(docs.where(fold(F.col("doc_id")) != 0))
    found = lang_id.identify(docs, model).withColumnRenamed("doc_id", "i").join(docs.select(F.col("doc_id").alias("i"), "lang"), "i")
    held = found.where(fold(F.col("i")) == 0).select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert held >= 0.97


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = lang_id.fit(empty)
    rows = spark.createDataFrame([(None, None, None), (1, "abc", "x"), (1, "abc", "x")], "doc_id long, text string, score string")
    assert [tuple(r)[1:3] for r in lang_id.identify(rows, model).collect()] == [("und", 0.0)] * 3
    assert lang_id.identify(empty, small_model()).count() == 0


def test_all_languages_and_ngrams_are_learned(spark):
    langs = [f"l{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, f"onlyin{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}", x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert model.languages == sorted(langs)
    found = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(docs, model).collect()}
    assert found == dict(enumerate(langs))


def test_very_long_text_and_clashing_names(spark):
    text = " ".join(["the house that was there"] * 60_000)
    rows = spark.createDataFrame([(1, text, "mine", 7, "own")], "doc_id long, text string, lang_pred string, score int, spans string")
    found = lang_id.labelled(rows, small_model())
    assert found.select("doc.*").columns == rows.columns and found.select("doc.*").drop("text").collect() == rows.drop("text").collect()
    assert [tuple(r) for r in found.select("lang_pred", "score", "spans").collect()] == [("en", 1.0, [("en", 0, 300_000)])]
