import random

import numpy as np
import pytest

from weftline.llm import jaccard_join as jj
from weftline.llm.components import connected_components


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(ident, least.get(root(i), ident))
    return sorted(((d, len(s), least.get(root(i)), links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [f"n{rng.randrange(10**6)}"] if r < rate / 2 else [] if r < rate else [w]
    return out


def corpus(rng, groups, copies, lengths, passage):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(lengths))]
        for _ in range(rng.randrange(1, copies)):
            text = edited(rng, base, rng.choice([0, 0.002, 0.01, 0.02, 0.05]))
            if rng.random() < 0.4:
                at = rng.randrange(len(text) + 1)
                text[at:at] = passage
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_links long")
    return sorted((tuple(r) for r in jj.jaccard_components(frame, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jj, "CHUNK", 4)  # many chunk pairs
    monkeypatch.setattr(jj, "HOT_SEEN", 2)  # and the way for common shingles
    monkeypatch.setattr(jj, "SAMPLE", 3)
    rng = random.Random(seed)
    rows = corpus(rng, 60, 9, [1, 3, 5, 8, 11, 14, 17, 20, 40, 90, 200], [f"p{i}" for i in range(30)])
    rows += [(None, rows[0][1]), (1, None), (2, ""), (3, " \n"), (rows[5][0], rows[9][1]), rows[7], (4, "Ab cD"), (5, "aB CD"), (None, "only null ids here")]
    assert found(spark, rows) == brute(rows)


def test_small_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b c d e"), (2, "x")]) == [(1, 2, 1, 0), (2, 1, 2, 0)]


def test_one_row_of_each_component(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base, *(f"e{k}" for k in range(n))]) for n in range(3)]
    rows = [(None, near[0], "a"), (None, near[1], "a"), (None, "alone one", "a"), (None, "alone two", "a"), (None, "alone two", "a"), (None, "alone two", "b")]
    rows += [(7, "first of seven", "a"), (7, "second of seven", "a"), (7, "second of seven", "a"), (9, "with an id", "a"), (None, "with an id", "a"), (8, "With AN id", "a")]
    rows += [(None, " ", "a"), (None, " ", "a"), (7, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["text"]) for r in jj.drop_near_copies(frame).collect()), key=str)
    assert [x for x in got if x[1] and x[1].startswith("w0 ")] in ([(None, near[0])], [(None, near[1])])
    rest = [(None, "alone one"), (None, "alone two"), (7, "first of seven"), (7, "second of seven"), (8, "With AN id"), (None, " "), (None, " "), (7, None)]
    assert [x for x in got if not (x[1] and x[1].startswith("w0 "))] == sorted(rest, key=str)


def test_subsets_meet():
    rng = np.random.default_rng(0)
    for n in range(1, jj.boundary() + 1):
        whole = rng.integers(0, 2**63, 3 * n + 3).astype(np.uint64)
        for m in range(jj.least_common(n), n + 1):
            a, b = np.sort(whole[:n]), np.sort(whole[:m])
            assert 100 * m < 85 * n or len(np.intersect1d(jj.subset_keys(a), jj.subset_keys(b)))


def test_verify_block_sees_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 400).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base, rng.integers(330, 400), replace=False), rng.integers(0, 2**62, 10).astype(np.uint64))) for _ in range(40)]
    keys = np.arange(40)
    roots, links = jj.verify_block(keys, sets, np.ones(40, np.int64), None, 85)
    want = [[100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) and i != j for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert links.tolist() == np.array(want).sum(1).tolist()
    for i in range(40):
        assert all(roots[i] == roots[j] for j in range(40) if want[i][j])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (102, 100), (None, 3), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
