"""Directed multigraph operators over edge tables (src, dst). Nothing is collected; loops write each
round to shared storage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.iterate import Budget, write_round


def resolve_name(entities: DataFrame, name: str | None = None, qualified: str | None = None) -> DataFrame:
    """Ids a query names. An explicit qualified name never falls back; a plain name with '.' or '::'
    is tried as qualified first and as a short name if nothing has it."""
    if qualified is not None:
        return entities.where(F.col("qualified") == qualified).select("id")
    short = entities.where(F.col("name") == name).select("id")
    if "::" not in name and "." not in name:
        return short
    exact = entities.where(F.col("qualified") == name).select("id")
    none = exact.limit(1).agg((F.count("*") == 0).alias("_none"))
    return exact.unionByName(short.crossJoin(F.broadcast(none)).where("_none").drop("_none"))  # one row


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into the targets (id)."""
    return edges.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def callees(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in (distinct callers), fan_out (distinct callees), calls_in."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"), F.count("*").alias("calls_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("fan_out"))
    both = into.join(out, "node", "full")
    return both.select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "calls_in")))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) that nothing calls."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, up: bool = False, budget: Budget | None = None, via: bool = False) -> DataFrame:
    """source, node, depth: breadth first from each seed (source, node), to a depth or to the end.

    Seeds have depth 0. `up` follows edges backwards. A level joins the frontier with the edges,
    drops what was reached before and is written once. via: a column more, the smallest node of the level before
    that leads to a node (null for seeds)."""
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = write_round(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node != next").distinct(), "edges")
    frontier = write_round(seeds.select("source", "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    if via:
        frontier = frontier.select("source", "node", F.lit(None).cast(steps.schema["node"].dataType).alias("via"), "depth")
    levels, level = [frontier], 0
    while depth is None or level < depth:
        level += 1
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        met = frontier.select("source", "node").join(steps, "node").select("source", F.col("next").alias("node"), F.col("node").alias("via"))
        once = met.groupBy("source", "node").agg(F.min("via").alias("via")) if via else met.select("source", "node").distinct()
        fresh = once.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(level))
        frontier = write_round(fresh, "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 16:  # deep graphs: one table for what was reached
            levels = [write_round(_union(levels), "reached")]
        if budget and not budget.goes_on(level + 1, _union(levels).count(), frontier.count()):
            break
    return _union(levels)


def chain(edges: DataFrame, starts: DataFrame, depth: int = 10, up: bool = False) -> DataFrame:
    """source, node, via, depth: what each start (source, node) reaches, once, at its least depth, and the
    smallest node of the level before that leads there. Nodes are ids or names, whichever the edges hold."""
    found = reach(edges, starts, depth, up, via=True)
    return found.where("depth > 0").select("source", "node", "via", "depth")


#: Neighbours that one row holds, and ranges of nodes that a source's reach is dealt by.
NEAR, RANGES = 256, 8


def reach_counts(edges: DataFrame, seeds: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """source, depth, n: how many nodes `reach` gives for each source and level, without a row for each of
    them on disk.

    The last level, by far the largest, is not written: rows of up to NEAR neighbours of a node within a range
    of nodes are shuffled by source and range, and only there become pairs, of which the least depth counts."""
    if depth < 1:
        return reach(edges, seeds, depth, up).groupBy("source", "depth").agg(F.count("*").alias("n"))
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = write_round(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node != next").distinct(), "edges")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(RANGES)).cast("int")
    nth = F.row_number().over(Window.partitionBy("node", "range").orderBy("next"))
    near = steps.withColumn("range", part("next")).withColumn("_nth", F.floor((nth - 1) / NEAR))
    near = write_round(near.groupBy("node", "range", "_nth").agg(F.collect_list("next").alias("nodes")).select("node", "range", "nodes"), "near")
    found = write_round(reach(steps.select(F.col("node").alias("src"), F.col("next").alias("dst")), seeds, depth - 1), "found")
    before = found.select("source", part("node").alias("range"), "depth", F.array("node").alias("nodes"))
    last = found.where(F.col("depth") == depth - 1).select("source", "node").join(near, "node").select("source", "range", F.lit(depth).alias("depth"), "nodes")
    dealt = before.unionByName(last).repartition("source", "range")
    # Dealt by source and range, so pairs are made distinct where they are.
    pairs = dealt.select("source", "range", "depth", F.explode("nodes").alias("node")).groupBy("source", "range", "node").agg(F.min("depth").alias("depth"))
    return pairs.groupBy("source", "range", "depth").agg(F.count("*").alias("n")).groupBy("source", "depth").agg(F.sum("n").alias("n"))


def chain_levels(chained: DataFrame) -> DataFrame:
    """source, depth, n, total: the nodes of each level of a chain and of all its levels."""
    return with_totals(chained.groupBy("source", "depth").agg(F.count("*").alias("n")))


def with_totals(levels: DataFrame) -> DataFrame:
    """source, depth, n with total, that of all levels of the source."""
    return levels.withColumn("total", F.sum("n").over(Window.partitionBy("source")))  # one row a level


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def frontier(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """node, role of the nodes a change (id) affects: direct_caller, direct_callee, upstream,
    downstream; direct ones are no transitive ones, callers come before callees."""
    seeds = changed.select(F.lit(0).alias("source"), F.col("id").alias("node"))
    up = reach(edges, seeds, depth, up=True).where("depth > 0").select("node", F.when(F.col("depth") == 1, 1).otherwise(3).alias("r"))
    down = reach(edges, seeds, depth).where("depth > 0").select("node", F.when(F.col("depth") == 1, 2).otherwise(4).alias("r"))
    roles = F.element_at(F.array(*map(F.lit, ("direct_caller", "direct_callee", "upstream", "downstream"))), F.col("r"))
    return up.unionByName(down).groupBy("node").agg(F.min("r").alias("r")).select("node", roles.alias("role"))


def layers(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, layer: 0 calls nothing, else one more than the highest callee's; -1 on or above a cycle.

    Kahn's peeling: a table holds the nodes without a layer and how many of their callees have none.
    A round takes those at zero, counts them off at their callers, and writes what is left: the table
    shrinks, and a round is one job, which also counts the next nodes at zero. Raises if nodes are left
    to take after `most` rounds."""
    calls = write_round(edges.select("src", "dst").distinct(), "edges")
    every = nodes.select(F.col("id").alias("node")).union(calls.select("src")).union(calls.select("dst")).distinct()
    out = calls.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("left"))

    def written(state: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        table = write_round(state.observe(seen, F.count_if(F.col("left") == 0).alias("free")), "layers")
        return table, seen.get["free"]

    state, free = written(every.join(out, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left")))
    done = []
    for layer in count():
        if not free:
            break
        if most is not None and layer >= most:
            raise RuntimeError(f"layers did not end in {most} rounds")
        ready = state.where("left = 0")
        done.append(ready.select("node", F.lit(layer).alias("layer")))
        if len(done) > 64:  # deep graphs: one table for what is done
            done = [write_round(_union(done), "done")]
        off = calls.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_off"))
        rest = state.where("left > 0").join(off, "node", "left")
        state, free = written(rest.select("node", (F.col("left") - F.coalesce("_off", F.lit(0))).alias("left")))
    return _union([*done, state.select("node", F.lit(-1).alias("layer"))])


#: Cycles beyond this length are looked for within strongly connected parts.
SHORT = 3
#: Distances that are met before strongly connected parts are looked for: so many, or so many an edge.
PAIRS = (1 << 22, 32)


def cycles(edges: DataFrame, longest: int = 10, most: int | None = None) -> DataFrame:
    """cycle: node arrays, smallest node first, of all cycles of 2 to `longest` nodes, once each.

    Paths grow from each start by larger nodes only, and only to nodes whose distance back to the start,
    over larger nodes, fits in what is left: a path that cannot close is not kept. most: the shortest ones
    up to that number, then by nodes, and a column partial that tells whether there are more; lengths are
    then tried one after another, so longer cycles than needed are not looked for, and strongly connected parts,
    which cost far more than short cycles, only if the distances outgrow the edges."""
    steps = write_round(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    if longest > SHORT:
        steps = _trimmed(steps) if most is not None else _within_parts(_trimmed(steps))
    found, n, tried = [], 0, 1
    most_pairs = max(PAIRS[0], PAIRS[1] * steps.count()) if most is not None and longest > SHORT else None
    while True:
        back, size, grown = None, 1, False
        for distance, level in _distances(steps):
            level = level.withColumn("distance", F.lit(distance))
            back = level if back is None else back.unionByName(level)
            size = distance + 1
            if grown := most_pairs is not None and back.count() > most_pairs:
                break
            if most is not None and size > tried:
                found.append(write_round(_closed(steps, back, size, (size,)), "cycles"))
                n, tried = n + found[-1].count(), size
            if size == longest or (most is not None and n > most):
                break
        if not grown:
            break
        steps, most_pairs = _within_parts(steps), None
    if most is None:
        return _closed(steps, back, size, range(2, size + 1)) if back is not None else _no_cycles(steps)
    if not found:
        return _no_cycles(steps).withColumn("partial", F.lit(False))
    return _union(found).orderBy(F.size("cycle"), "cycle").limit(most).withColumn("partial", F.lit(n > most))


def _no_cycles(steps: DataFrame) -> DataFrame:
    return steps.select(F.array("src").alias("cycle")).limit(0)


def _trimmed(steps: DataFrame) -> DataFrame:
    """Edges (written) whose beginning has an edge in and whose end has one out, found again as long as a tenth
    of them goes: those of all cycles stay. Without copies of a side, which may have millions of rows."""
    n = steps.count()
    while n:
        ins, outs = steps.select(F.col("dst").alias("src")).distinct(), steps.select(F.col("src").alias("dst")).distinct()
        kept = steps.join(ins.hint("merge"), "src", "left_semi").join(outs.hint("merge"), "dst", "left_semi")
        before, steps = n, write_round(kept.select("src", "dst"), "edges")
        n = steps.count()
        if 10 * n > 9 * before:
            break
    return steps


def _within_parts(steps: DataFrame) -> DataFrame:
    """Edges (written) within strongly connected parts."""
    part = strong_components(steps)
    a, b = part.select(F.col("node").alias("src"), F.col("component").alias("p")), part.select(F.col("node").alias("dst"), F.col("component").alias("p"))
    return write_round(steps.join(a, "src").join(b, ["dst", "p"]).select("src", "dst"), "edges")


def _distances(steps: DataFrame):
    """distance, (start, node): nodes above a start that lead to it over such nodes, level by level, each once."""
    level = write_round(steps.where("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("node")), "back")
    seen, distance = level, 1
    while not level.isEmpty():
        yield distance, level
        fresh = level.join(steps.withColumnRenamed("dst", "node"), "node").where("src > start").select("start", F.col("src").alias("node")).distinct()
        level = write_round(fresh.join(seen, ["start", "node"], "left_anti"), "back")
        seen = seen.unionByName(level)
        distance += 1
        if distance % 16 == 0:
            seen = write_round(seen, "seen")


def _closed(steps: DataFrame, back: DataFrame, size: int, sizes) -> DataFrame:
    """Cycles of the given sizes, `size` at most. back: start, node, distance."""
    paths = steps.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("node"))
    found = []
    for k in range(2, size + 1):
        paths = paths.join(back.where(F.col("distance") <= size - k + 1), ["start", "node"])
        paths = write_round(paths, "paths")
        if k in sizes:
            found.append(paths.where("distance = 1").select(F.col("path").alias("cycle")))
        on = paths.drop("distance").join(steps, F.col("node") == F.col("src")).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
        paths = on.select(F.concat("path", F.array("dst")).alias("path"), "start", F.col("dst").alias("node"))
    return _union(found)


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all strongly connected parts of two nodes or more.

    Each round draws a rank for every node; a node's colour is the node of least rank that reaches it, so
    parts never lie in two colours, and what reaches its colour's node within the colour is a part. Edges
    between colours and the parts found go; as ranks are drawn anew, about half of a long path's nodes lose
    their colour a round."""
    rest = write_round(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    found = rest.select(F.col("src").alias("component"), F.col("src").alias("node")).limit(0)
    for r in count():
        if rest.isEmpty():
            return found
        colours = _colours(rest, r)
        a, b = colours.select(F.col("node").alias("src"), F.col("top").alias("c")), colours.select(F.col("node").alias("dst"), F.col("top").alias("c"))
        kept = write_round(rest.join(a, "src").join(b, ["dst", "c"]).select("src", "dst"), "edges")
        tops = colours.select(F.col("top").alias("source"), F.col("top").alias("node")).distinct()
        part = reach(kept, tops, None, up=True)
        least = part.groupBy("source").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = write_round(found.unionByName(part.join(least, "source").select("component", "node")), "parts")
        gone = part.select("node")
        rest = kept.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = write_round(rest.select("src", "dst"), "edges")


def _colours(edges: DataFrame, draw: int) -> DataFrame:
    """node, top: the node of least rank that reaches it, itself included."""
    ranked = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = write_round(ranked.select("node", F.xxhash64(F.lit(draw), "node").alias("rank"), F.col("node").alias("top")), "colours")
    while True:
        own = F.struct("rank", "top")
        near = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(own).alias("_near"))
        lower = labels.withColumn("_own", own).join(near, "node", "left").select("node", F.col("top").alias("_old"), F.least("_own", "_near").alias("_low"))
        # What reaches a node's top reaches the node.
        jump = labels.select(F.col("node").alias("_at"), own.alias("_far"))
        least = lower.join(jump, F.col("_low.top") == F.col("_at")).select("node", "_old", F.least("_low", "_far").alias("_new"))
        after = write_round(least.select("node", F.col("_new.rank").alias("rank"), F.col("_new.top").alias("top"), "_old"), "colours")
        labels = after.drop("_old")
        if after.where("top != _old").isEmpty():
            return labels.select("node", "top")


def _closed_walk(steps: DataFrame, longest: int | None) -> tuple[int, DataFrame]:
    """The length of the shortest cycle of distinct edges and the smallest nodes (start) of those of that
    length; 0 if there is none."""
    steps = write_round(steps, "edges")
    hit = steps.where("src = dst").select(F.col("src").alias("start"))
    if not hit.isEmpty():
        return 1, hit
    for distance, level in _distances(steps):
        if longest is not None and distance >= longest:
            break
        hit = level.join(steps.select(F.col("src").alias("start"), F.col("dst").alias("node")), ["start", "node"]).select("start")
        if not hit.isEmpty():
            return distance + 1, hit
    return 0, hit.limit(0)


def shortest_cycle(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """length: that of the shortest cycle, by distances back to its smallest node; no row
    if there is none (up to `longest`, if given). A loop has length 1."""
    length, hit = _closed_walk(edges.select("src", "dst").distinct(), longest)
    return hit.limit(1 if length else 0).select(F.lit(length).alias("length"))


def shortest_cycle_path(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """cycle: the nodes of a shortest cycle, in order: that of the smallest node on any, closed by the smallest
    callers from its end. One row, or none if there is no cycle."""
    steps = write_round(edges.select("src", "dst").distinct(), "edges")
    length, hit = _closed_walk(steps, longest)
    start = hit.agg(F.min("start").alias("node"))
    path = start.select(F.array("node").alias("cycle"), F.col("node").alias("dst"))
    if length > 1:
        levels = reach(steps, start.select(F.col("node").alias("source"), "node"), length - 1)
        for depth in range(length - 1, 0, -1):  # one row
            back = path.join(steps, "dst").join(levels.where(F.col("depth") == depth).select(F.col("node").alias("src")), "src")
            path = back.groupBy("cycle").agg(F.min("src").alias("dst")).select(F.concat(F.slice("cycle", 1, 1), F.array("dst"), F.expr("slice(cycle, 2, size(cycle))")).alias("cycle"), "dst")
    return path.where(F.lit(length > 0)).select("cycle")


def module_graph(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """src_module, dst_module, calls, callers, callees between different modules.

    module_of: id, module."""
    src = module_of.select(F.col("id").alias("src"), F.col("module").alias("src_module"))
    dst = module_of.select(F.col("id").alias("dst"), F.col("module").alias("dst_module"))
    grouped = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(src, "src").join(dst, "dst").where("src_module != dst_module")
    return grouped.groupBy("src_module", "dst_module").agg(F.sum("n").alias("calls"), F.countDistinct("src").alias("callers"), F.countDistinct("dst").alias("callees"))


def coupling(module_edges: DataFrame, a: str = "src_module", b: str = "dst_module", n: str = "calls") -> DataFrame:
    """module, afferent, efferent, instability of edges between modules."""
    out = module_edges.select(F.col(a).alias("module"), F.lit(0).cast("long").alias("i"), F.col(n).alias("o"))
    into = module_edges.select(F.col(b).alias("module"), F.col(n).alias("i"), F.lit(0).cast("long").alias("o"))
    sums = out.unionByName(into).groupBy("module").agg(F.sum("i").alias("afferent"), F.sum("o").alias("efferent"))
    return sums.withColumn("instability", ratio(F.col("efferent"), F.col("afferent") + F.col("efferent")))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def risk_of(count: Column, high: int, medium: int) -> Column:
    return F.when(count > high, "high").when(count > medium, "medium").otherwise("low")


def reach_sets(edges: DataFrame, seeds: DataFrame, depth: int, up: bool = False) -> DataFrame:
    """node, bucket, bits: the sources (longs) that reach each node within depth, as bitmaps of 32,768 sources a
    bucket. seeds: source, node; sources of one node travel together. A round sends on the bitmaps that have
    grown, so there is one row for a node and bucket, not one for a node and source; sources should be
    numbered densely (sparse ones only cost rows)."""
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = write_round(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node != next").distinct(), "edges")
    own = seeds.groupBy("node", F.bitmap_bucket_number("source").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("source")).alias("bits"))
    state = write_round(own, "sets")
    fresh = state
    for _ in range(depth):
        sent = fresh.join(steps, "node").groupBy(F.col("next").alias("node"), "bucket").agg(F.bitmap_or_agg("bits").alias("sent"))
        both = state.join(sent, ["node", "bucket"], "full")
        either = both.where("bits is null or sent is null").select("node", "bucket", F.coalesce("bits", "sent").alias("bits"), F.col("bits").isNull().alias("grown"))
        # Both: the two rows of a node meet in the aggregate once more.
        pairs = both.where("bits is not null and sent is not null").select("node", "bucket", "bits", F.explode(F.array("bits", "sent")).alias("one"))
        joined = pairs.groupBy("node", "bucket", "bits").agg(F.bitmap_or_agg("one").alias("all")).select("node", "bucket", F.col("all").alias("bits"), (F.col("all") != F.col("bits")).alias("grown"))
        after = write_round(either.unionByName(joined), "sets")
        state, fresh = after.drop("grown"), after.where("grown").drop("grown")
    return state


def vulnerability(edges: DataFrame, findings: DataFrame, depth: int = 3, top: int = 20) -> DataFrame:
    """node, n_findings of the nodes that at least two findings (id, node) reach upwards; the top ones.

    The findings on all walks from a node are never fewer than those it is reached by, and are sums that take
    one join a level. What the nodes with the highest sums have, counted exactly, is a bound that leaves few
    nodes to count; all that may be among the top ones are."""
    steps = write_round(edges.select("src", "dst").where("src != dst").distinct(), "edges")
    found = write_round(findings.select("id", "node").distinct(), "findings")
    level = write_round(found.groupBy("node").agg(F.count("*").cast("double").alias("most")), "walks")
    levels = [level]
    for _ in range(depth):
        level = write_round(level.join(steps, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg(F.sum("most").alias("most")), "walks")
        levels.append(level)
    bounds = write_round(_union(levels).groupBy("node").agg(F.sum("most").alias("most")).where("most >= 2"), "bounds")

    def counted(nodes: DataFrame) -> DataFrame:
        below = reach(steps, nodes.select(F.col("node").alias("source"), "node"), depth)
        return below.join(found, "node").groupBy(F.col("source").alias("node")).agg(F.countDistinct("id").alias("n_findings"))

    first = write_round(bounds.orderBy(F.col("most").desc(), "node").limit(top), "first")
    known = write_round(counted(first), "counted")
    least = known.agg(F.when(F.count("*") >= top, F.min("n_findings"))).first()[0] or 2  # fewer than top: all are counted
    rest = bounds.where(F.col("most") >= least).join(first, "node", "left_anti")
    counts = known.unionByName(write_round(counted(rest), "counted")).where("n_findings >= 2")
    return counts.orderBy(F.col("n_findings").desc(), "node").limit(top)


def rollup(parents: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """node and the sums of columns over each node and all below it. parents: node, parent (null or in no row
    of values: a root); values: node and columns, a row a node.

    A node's sum over the levels within 2^k below it and its ancestor 2^k above are kept: a round adds what
    those ancestors' others have and doubles the distance. One row a node at any depth, as many rounds as a
    depth has binary digits. Raises if the parents have a cycle."""
    up = parents.select("node", "parent").join(values.select(F.col("node").alias("parent")), "parent", "left_semi")
    rows = write_round(values.select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]).join(up, "node", "left").withColumnRenamed("parent", "up"), "sums")
    n = rows.count()
    for k in count():
        linked = rows.where("up is not null")
        if linked.isEmpty():
            return rows.select("node", *columns)
        if 2**k > n:
            raise RuntimeError("the parents have a cycle")
        below = linked.groupBy(F.col("up").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        jump = rows.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        added = rows.join(below, "node", "left").join(jump, "up", "left")
        rows = write_round(added.select("node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns], F.col("_next").alias("up")), "sums")


def descend(children: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """ancestor, node, depth of a tree given as (child, parent), level by level to its end. Raises if it
    is deeper than `most`, or has a cycle."""
    steps = write_round(children.select(F.col("child").alias("next"), F.col("parent").alias("node")), "children")
    longest = steps.count()  # a path with more steps has one twice
    frontier = write_round(roots.select(F.col("id").alias("ancestor"), F.col("id").alias("node"), F.lit(0).alias("depth")), "frontier")
    levels = [frontier]
    for level in count(1):
        fresh = frontier.join(steps, "node").select("ancestor", F.col("next").alias("node"), F.lit(level).alias("depth"))
        frontier = write_round(fresh, "frontier")
        if frontier.isEmpty():
            return _union(levels)
        if level > longest or (most is not None and level > most):
            raise RuntimeError(f"the tree did not end at depth {level - 1}")
        levels.append(frontier)
        if len(levels) > 16:  # deep trees: one table for what was reached
            levels = [write_round(_union(levels), "reached")]
