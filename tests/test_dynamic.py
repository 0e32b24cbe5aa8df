import random

import pytest

from weftline.operators import dynamic
from weftline.operators import graph as g
from weftline.operators.dynamic import edge_changes, impact_delta, layers_delta


def naive_layers(pairs, nodes):
    """Least solution by peeling; what is left is on or above a cycle."""
    callees = {n: {b for a, b in pairs if a == n} for n in nodes}
    done = {}
    while ready := [n for n in nodes if n not in done and callees[n] <= done.keys()]:
        done |= {n: 1 + max((done[c] for c in callees[n]), default=-1) for n in ready}
    return {n: done.get(n, -1) for n in nodes}


def frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def some(rng, n, m):
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


CASES = {
    "few": (some(random.Random(5), 200, 170), some(random.Random(5), 200, 170) - {sorted(some(random.Random(5), 200, 170))[40]} | {(7, 9), (9, 150)}),
    # Parts of their own: a cycle closed by two edges; one broken and another closed; a loop and new nodes.
    "cycles": (
        {(1, 2), (3, 4), (5, 1), (31, 32), (32, 31), (33, 31), (31, 39), (41, 42)},
        {(1, 2), (3, 4), (5, 1), (2, 3), (4, 1), (31, 32), (33, 31), (31, 39), (39, 33), (38, 38), (41, 42), (20, 21), (42, 42)},
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_layers_delta(spark, case):
    old, new = CASES[case]
    nodes = sorted({x for p in old | new for x in p})
    before, after = naive_layers(old, nodes), naive_layers(new, nodes)
    layers = spark.createDataFrame(sorted((n, x) for n, x in before.items() if n != 20 or case == "few"), "node long, layer int")
    added, removed = edge_changes(frame(spark, old), frame(spark, new))
    found = {r["node"]: (r["old_layer"], r["new_layer"]) for r in layers_delta(frame(spark, new), added, removed, layers).collect()}
    assert found == {n: (before[n], after[n]) for n in nodes if before[n] != after[n]}


def test_no_change_and_impact(spark):
    old = frame(spark, {(1, 2), (2, 3), (3, 4)})
    new = frame(spark, {(1, 2), (3, 4), (2, 4)})
    layers = g.layers(spark.createDataFrame([(1,)], "id long"), old)
    none = edge_changes(old, old)
    assert layers_delta(old, *none, layers).count() == 0
    added, removed = edge_changes(old, new)
    found = {tuple(r) for r in impact_delta(old, new, added, removed, 2).collect()}
    assert found == {(2, 3, "downstream", "removed")}
    found = {tuple(r) for r in impact_delta(new, old, removed, added, 1).collect()}
    assert found == {(2, 3, "downstream", "added"), (2, 4, "downstream", "removed")}


def test_search_for_cycles_grows_with_nodes(spark, monkeypatch):
    old = {(i, 100) for i in range(30)} | {(100, j) for j in range(200, 230)}
    new = old | {(300 + i, i) for i in range(30)} | {(205, 300)}
    layers = g.layers(spark.createDataFrame([(i,) for i in range(300, 330)], "id long"), frame(spark, old))
    added, removed = edge_changes(frame(spark, old), frame(spark, new))
    sizes, write = [], dynamic.write_round

    def written(rows, *name):
        table = write(rows, *name)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(dynamic, "write_round", written)
    found = {r["node"]: r["new_layer"] for r in layers_delta(frame(spark, new), added, removed, layers).collect()}
    nodes = sorted({x for p in new for x in p})
    before, after = naive_layers(old, nodes), naive_layers(new, nodes)
    assert found == {n: after[n] for n in nodes if before[n] != after[n]}
    assert max(sizes) <= len(new)  # pairs of a beginning and what it meets would be 960
