import random

import pytest

from weftline.operators import graph as g
from weftline.plans.iterate import Budget


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def model_reach(pairs, start, depth=None):
    seen, front, level = {start: 0}, {start}, 0
    while front and (depth is None or level < depth):
        level += 1
        front = {b for a, b in pairs if a in front and b not in seen}
        seen |= dict.fromkeys(front, level)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_against_model(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    seeds = spark.createDataFrame([(0, 0), (7, 7)], "source long, node long")
    for depth, up in ((2, False), (None, True)):
        got = {(r["source"], r["node"]): r["depth"] for r in g.reach(frame(spark, pairs), seeds, depth, up).collect()}
        walked = [(b, a) for a, b in pairs] if up else pairs
        assert got == {(s, n): d for s in (0, 7) for n, d in model_reach(walked, s, depth).items()}


def test_layers_and_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (5, 3), (6, 6)]
    layers = {r["node"]: r["layer"] for r in g.layers(nodes, frame(spark, pairs)).collect()}
    assert layers == {2: 0, 1: 1, 0: 2, 7: 0, 3: -1, 4: -1, 5: -1, 6: -1}
    assert [r["cycle"] for r in g.cycles(frame(spark, pairs)).collect()] == [[3, 4]]
    ring = [(5, 3), (3, 9), (9, 5), (5, 9), (1, 5)]
    assert sorted(r["cycle"] for r in g.cycles(frame(spark, ring)).collect()) == [[3, 9, 5], [5, 9]]
    assert g.cycles(frame(spark, [(1, 2), (2, 3)])).count() == 0
    assert g.shortest_cycle(frame(spark, pairs)).first()["length"] == 1
    assert g.shortest_cycle(frame(spark, ring[:3])).first()["length"] == 3
    assert g.shortest_cycle(frame(spark, [(1, 2)])).count() == 0


def test_names(spark):
    rows = spark.createDataFrame([(1, "f", "m::f"), (2, "f", "n::f"), (3, "a.b", "x::a.b")], "id long, name string, qualified string")
    ids = lambda **k: sorted(r["id"] for r in g.resolve_name(rows, **k).collect())
    assert ids(name="f") == [1, 2]
    assert ids(name="m::f") == [1]  # taken as qualified
    assert ids(name="a.b") == [3]  # nothing qualified: falls back
    assert ids(qualified="a.b") == []  # explicit: never falls back


def test_frontier_is_disjoint(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 1)]
    got = {r["node"]: r["role"] for r in g.frontier(frame(spark, pairs), spark.createDataFrame([(3,)], "id long"), 3).collect()}
    assert got == {2: "direct_caller", 1: "upstream", 4: "direct_callee", 5: "downstream"}


def test_degrees_orphans_budget(spark):
    edges = frame(spark, [(1, 2), (1, 2), (3, 2), (2, 3)])
    assert sorted(tuple(r) for r in g.degrees(edges).collect()) == [(1, 0, 1, 0), (2, 2, 1, 3), (3, 1, 1, 1)]
    assert [r["id"] for r in g.orphans(spark.createDataFrame([(1,), (2,)], "id long"), edges).collect()] == [1]
    budget = Budget(depth=5, nodes=2, results=1)
    g.reach(edges, spark.createDataFrame([(1, 1)], "source long, node long"), 5, budget=budget)
    assert budget.partial
    assert budget.cut(edges, "src", "dst").collect()[0]["partial"]


def test_tree(spark):
    children = spark.createDataFrame([(2, 1), (3, 1), (4, 3)], "child long, parent long")
    got = sorted(tuple(r) for r in g.descend(children, spark.createDataFrame([(1,)], "id long")).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]


def test_bounds_are_not_silent(spark):
    nodes, chain = spark.createDataFrame([(0,)], "id long"), [(i, i + 1) for i in range(4)]
    with pytest.raises(RuntimeError):
        g.layers(nodes, frame(spark, chain), most=3)
    assert {r["node"]: r["layer"] for r in g.layers(nodes, frame(spark, chain), most=5).collect()} == {i: 4 - i for i in range(5)}
    children = frame(spark, chain).toDF("parent", "child")
    with pytest.raises(RuntimeError):
        g.descend(children, nodes, most=3)
    assert sorted(tuple(r) for r in g.descend(children, nodes, most=4).collect()) == [(0, i, i) for i in range(5)]
    with pytest.raises(RuntimeError):
        g.descend(frame(spark, [(0, 1), (1, 0)]).toDF("parent", "child"), nodes)
    assert g.layers.__defaults__ == (None,) and g.descend.__defaults__ == (None,)


def model_parts(pairs):
    reached = {n: set(model_reach(pairs, n)) for n in {x for p in pairs for x in p}}
    parts = {n: {m for m in reached[n] if n in reached[m]} for n in reached}
    return {n: min(p) for n, p in parts.items() if len(p) > 1}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(40)],
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (9, 8), (8, 7)],
    [(random.Random(i).randrange(30), random.Random(i + 1000).randrange(30)) for i in range(45)],
    [],
])
def test_strong_components_against_model(spark, pairs):
    got = {r["node"]: r["component"] for r in g.strong_components(frame(spark, pairs)).collect()}
    assert got == model_parts(pairs)


def test_shortest_cycle_of_any_length(spark):
    ring = [(i, (i + 1) % 12) for i in range(12)]
    assert g.shortest_cycle(frame(spark, ring)).first()["length"] == 12
    assert g.shortest_cycle_path(frame(spark, ring)).first()["cycle"] == list(range(12))
    assert g.shortest_cycle(frame(spark, ring), longest=10).count() == 0
    assert g.shortest_cycle_path(frame(spark, [*ring, (7, 5), (4, 4)])).first()["cycle"] == [4]
    assert g.shortest_cycle_path(frame(spark, [*ring, (7, 5)])).first()["cycle"] == [5, 6, 7]
    assert g.shortest_cycle_path(frame(spark, [(1, 2), (2, 3)])).count() == 0


def test_chain_by_names(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "a"), ("d", "e")], "src string, dst string")
    start = spark.createDataFrame([("a", "a")], "source string, node string")
    found = g.chain(pairs, start).collect()
    assert sorted((r["node"], r["via"], r["depth"]) for r in found) == [("b", "a", 1), ("c", "a", 1), ("d", "b", 2), ("e", "d", 3)]
    levels = g.chain_levels(g.chain(pairs, start, 2)).collect()
    assert sorted((r["depth"], r["n"], r["total"]) for r in levels) == [(1, 2, 3), (2, 1, 3)]


def test_budget_of_a_level_and_of_time(spark):
    pairs = [(0, i) for i in range(1, 8)] + [(7, 8), (8, 9)]
    seed = spark.createDataFrame([(0, 0)], "source long, node long")
    for limits, most in ((Budget(frontier=3), 1), (Budget(seconds=0.0), 2), (Budget(), 3)):
        assert g.reach(frame(spark, pairs), seed, None, budget=limits).agg({"depth": "max"}).first()[0] == most
        assert limits.partial == (most < 3)


def naive_cycles(pairs, longest):
    found, steps = set(), {}
    for a, b in pairs:
        steps.setdefault(a, set()).add(b)

    def grow(path):
        for b in steps.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                found.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                grow([*path, b])

    for a in steps:
        grow([a])
    return sorted(found, key=lambda c: (len(c), c))


def test_long_cycles(spark):
    rng = random.Random(8)
    pairs = [(i, (i + 1) % 10) for i in range(10)] + [(20 + rng.randrange(12), 20 + rng.randrange(12)) for _ in range(30)] + [(40, 41), (41, 3)]
    want = naive_cycles(pairs, 10)
    assert max(map(len, want)) == 10 and len(want) > 8
    assert sorted(tuple(r["cycle"]) for r in g.cycles(frame(spark, pairs), 10).collect()) == sorted(want)
    some = g.cycles(frame(spark, [p for p in pairs if p[0] >= 20]), 10, most=3).collect()
    assert [tuple(r["cycle"]) for r in some] == want[:3] and all(r["partial"] for r in some)
    ring = frame(spark, [(i, (i + 1) % 6) for i in range(6)])
    assert g.shortest_cycle(ring).first()["length"] == 6 and g.shortest_cycle(ring, 5).count() == 0


def test_first_cycles_without_parts(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(20 + rng.randrange(12), 20 + rng.randrange(12)) for _ in range(30)] + [(40 + i, 41 + i) for i in range(6)] + [(46, 25), (25, 60), (60, 61), (61, 62), (62, 61)]
    want = [list(c) for c in naive_cycles(pairs, 4)]
    rows = lambda pairs, most: [(r["cycle"], r["partial"]) for r in g.cycles(frame(spark, pairs), 4, most=most).collect()]
    sought = []
    parts = g.strong_components
    monkeypatch.setattr(g, "strong_components", lambda steps: sought.append(1) or parts(steps))
    assert rows(pairs, 3) == [(c, True) for c in want[:3]]
    assert rows([(1, 2), (2, 3), (1, 3)], 5) == []
    assert not sought  # they were found first, in some hundreds of jobs
    monkeypatch.setattr(g, "PAIRS", (12, 0))
    assert rows(pairs, 500) == [(c, False) for c in want] and sought == [1]
    kept = g._trimmed(frame(spark, pairs).where("src <> dst").distinct())
    assert 40 not in {x for r in kept.collect() for x in r}


def test_sets_of_sources(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(15), rng.randrange(15)) for _ in range(25)]
    seeds = [(s, rng.randrange(15)) for s in (0, 1, 2, 40_000, 40_001, 100_000)] + [(1, 3)]
    rows = spark.createDataFrame(seeds, "source long, node long")
    for depth, up in ((2, True), (3, False)):
        walked = [(b, a) for a, b in pairs] if up else pairs
        want = {}
        for s, n in seeds:
            for x in model_reach(walked, n, depth):
                want.setdefault(x, set()).add(s)
        found = {}
        for r in g.reach_sets(frame(spark, pairs), rows, depth, up).collect():
            first = 32_768 * (r["bucket"] - 1) + 1 if r["bucket"] else 0  # 0 has a bucket of its own
            bits = {first + 8 * i + k for i, byte in enumerate(r["bits"]) for k in range(8) if byte >> k & 1}
            found.setdefault(r["node"], set()).update(bits)
        assert found == want


def test_rollup(spark):
    rng = random.Random(7)
    parent = {i: rng.randrange(i) for i in range(1, 60)} | {70: 99, 71: None}
    value = {i: i % 5 for i in [*range(60), 70, 71, 72]}
    below = lambda n: value[n] + sum(below(c) for c, p in parent.items() if p == n)
    links = spark.createDataFrame(sorted(parent.items()), "node long, parent long")
    values = spark.createDataFrame(sorted(value.items()), "node long, v long")
    assert {r["node"]: r["v"] for r in g.rollup(links, values, "v").collect()} == {n: below(n) for n in value}
    n = 10_000  # a chain
    chain = spark.range(n).selectExpr("id as node", "case when id > 0 then id - 1 end as parent", "1L as v")
    sums = g.rollup(chain.select("node", "parent"), chain.select("node", "v"), "v")
    assert sums.count() == n and sums.where(f"v != {n} - node").count() == 0
    with pytest.raises(RuntimeError):
        g.rollup(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), spark.createDataFrame([(1, 1), (2, 1)], "node long, v long"), "v")


@pytest.mark.parametrize("seed", [3, 4])
def test_counts_of_levels_without_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)]
    seeds = spark.createDataFrame([(n, n) for n in range(0, 30, 3)] + [(0, 7), (99, 99)], "source long, node long")
    monkeypatch.setattr(g, "NEAR", 2)  # several rows of neighbours a node
    for depth, up in ((0, False), (1, True), (2, True), (3, False)):
        want = g.reach(frame(spark, pairs), seeds, depth, up).groupBy("source", "depth").count().collect()
        assert sorted(map(tuple, g.reach_counts(frame(spark, pairs), seeds, depth, up).collect())) == sorted(map(tuple, want))
    via = g.chain(frame(spark, pairs), seeds.where("source = 3"), 3).collect()
    level = {3: 0} | {r["node"]: r["depth"] for r in via}
    assert all(r["via"] == min(a for a, b in pairs if b == r["node"] and level.get(a) == r["depth"] - 1) for r in via)


def test_vulnerability_without_sets_of_sources(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(45)]
    found = [(rng.randrange(12) * 1_000_003, rng.randrange(24)) for _ in range(40)]  # some ids at several nodes
    monkeypatch.setattr(g, "reach_sets", None)  # a bitmap a node and bucket is large where ids are sparse
    up = {n: {a for a in range(24) if n in model_reach(pairs, a, 2)} for n in range(24)}
    want = {a: len({i for i, n in found if a in up[n]}) for a in range(24)}
    want = sorted(((a, n) for a, n in want.items() if n >= 2), key=lambda x: (-x[1], x[0]))
    got = g.vulnerability(frame(spark, pairs), spark.createDataFrame(found, "id long, node long"), 2, 6).collect()
    assert [tuple(r) for r in got] == want[:6]
