import os

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import quality_classifier as qc
from weftline.llm.common import fold

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, 5, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if 3 in r else -1.0 for r in rows])
    values, cost = np.ones(12), np.full(60, 0.5)
    w = qc.dual_coordinate_descent(rows, values, y, cost, epochs=500)

    def loss(w):
        return w @ w / 2 + sum(c * max(0, 1 - t * (w[r].sum() + w[-1])) for r, t, c in zip(rows, y, cost, strict=True))

    assert all(loss(w) <= loss(w + rng.normal(0, s, 13)) + 1e-2 for s in (0.01, 0.1, 1) for _ in range(50))


def test_shape_of_a_whole_word():
    assert qc.shape("a" * 70 + "7B") == "a0A"


def test_one_class_and_empty(spark):
    assert qc.fit_rows([], np.zeros(0)).score(np.zeros(0, np.int32)) == 0.5
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    scores = [r["score"] for r in qc.score(docs, model).collect()]
    assert len(scores) == 3 and all(0 < s < 1 for s in scores)
    assert qc.score(docs.limit(0), model).count() == 0


def test_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = qc.fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    rows = qc.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9
