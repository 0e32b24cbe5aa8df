import numpy as np
import pytest

from weftline.llm import ann


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    norm = np.sqrt((v * v).sum(1))
    out = {}
    for i, q in queries:
        scores = (v * q).sum(1) / (norm * np.sqrt((np.array(q) ** 2).sum()))
        order = sorted((-s, j) for s, j in zip(scores.tolist(), ids.tolist(), strict=True) if j != i)[:k]
        out[i] = [(j, -s) for s, j in order]
    return out


@pytest.mark.parametrize("shard_size", [5000, 300])
def test_recall(spark, shard_size):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    vectors = (centres[rng.integers(0, 8, 1500)] + rng.normal(size=(1500, 16)) * 0.7).astype(np.float32).astype(float)
    vectors[200:400] = vectors[200]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(ann.build_index(frame, shard_size=shard_size), frame.where("vec_id % 50 = 0")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    hits = sum(len({x for x, _ in want[q]} & {x for x, _ in found[q].values()}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [found[250][k][0] for k in range(1, 6)] == [200, 201, 202, 203, 204]
    assert [found[200][k][0] for k in range(1, 6)] == [201, 202, 203, 204, 205]


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (50, [1.0]), (6, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = [tuple(r) for r in ann.search(ann.build_index(frame), frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 6, 0.0)]
    assert ann.search(ann.build_index(frame.limit(0)), frame).count() == 0
