import math

from weftline.llm.mixing import mix_sources, plan_mix, source_targets


def fill(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1000, None: 50}, {"x": 7}, {"a": 0, "b": 0}, {f"s{i}": i * i for i in range(12)}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        found = {r["source"]: r["target"] for r in source_targets(rows).collect()}
        want = fill(sizes, (5, 2, 1))
        assert found.keys() == sizes.keys()
        assert all(math.isclose(found[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_mix(spark):
    rows = [(i, "w " * (i * 7919 % 40), None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}", "x") for i in range(600)]
    rows += [(None, None, "s0", "x"), (5, "", None, "x"), rows[7], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    plan = plan_mix(docs).collect()
    assert len(plan) == len(rows)
    assert sorted(map(str, plan)) == sorted(map(str, plan_mix(docs.repartition(3)).collect()))
    for source in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in plan)
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert plan_mix(docs.limit(0)).count() == 0
