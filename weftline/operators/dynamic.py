"""Layers and reach of a graph after a change of edges, from what they were before and the change alone.

Work follows the change: a round looks up the callees of nodes whose layer may have changed, and goes
on to the callers of those whose layer did. Tables a round makes are written, so lineage stays short."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import write_round
from .graph import layers as peeled
from .graph import reach, strong_components

#: The layer of nodes on or above a cycle, above all others.
TOP = 1 << 30
#: Up to so many nodes are written into a scan's filter, which then skips what holds none of them.
NAMED = 500
#: Beyond so many rows a table meets others by a shuffle: its files' size would have it collected on the driver.
COPIED = 300_000


def edge_changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges that came and that went."""
    old, new = (x.select("src", "dst").distinct() for x in (old, new))
    # No side is copied, however little room its files take: both are whole graphs.
    return new.join(old.hint("merge"), ["src", "dst"], "left_anti"), old.join(new.hint("merge"), ["src", "dst"], "left_anti")


class Rows(NamedTuple):
    """A table of a round: written, or held as it is if it is small. ids: then also the values of its node column.
    many: it has more than COPIED rows."""

    frame: DataFrame
    ids: list | None
    many: bool = False

    @property
    def empty(self) -> bool:
        return self.ids == []

    def touching(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose column is one of the nodes."""
        if self.ids is not None:
            return rows.where(F.col(column).isin(self.ids))
        return rows.join(self.side(self.frame.select(F.col("node").alias(column)).distinct()), column, "left_semi")

    def side(self, rows: DataFrame) -> DataFrame:
        """Rows made of this table's, as the side of a join."""
        return rows.hint("merge") if self.many else rows


def _settle(rows: DataFrame) -> Rows:
    some = rows.limit(NAMED + 1).collect()
    if len(some) <= NAMED:
        return Rows(rows.sparkSession.createDataFrame(some, rows.schema).coalesce(1), sorted({r["node"] for r in some}))
    table = write_round(rows)
    return Rows(table, None, table.count() > COPIED)


def _layers_of(nodes: Rows, layers: DataFrame, changed: list[DataFrame]) -> DataFrame:
    """node, layer of some nodes: the last of their changes, else the stored layer, else 0."""
    rows = nodes.touching(layers, "node").withColumn("round", F.lit(-1))
    for k, x in enumerate(changed):
        rows = rows.unionByName(nodes.touching(x.select("node", "layer"), "node").withColumn("round", F.lit(k)))
    last = rows.groupBy("node").agg(F.max_by("layer", "round").alias("layer"))
    return nodes.frame.select("node").distinct().join(nodes.side(last), "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))


def _nodes(column: Column, rows: DataFrame) -> DataFrame:
    return rows.select(column.alias("node")).distinct()


def _on_new_cycles(edges: DataFrame, added: DataFrame, layers: DataFrame) -> DataFrame:
    """Callers of added edges that lie on a cycle through them.

    Layers fall along an edge. A cycle that is new has an added edge along which they do not, and its nodes are
    met by one search from the ends of these, down to the least layer they begin at: a set of nodes, not of
    pairs of a beginning and a node. Of these, what is left by peeling from both sides is on or between cycles,
    and an edge within a strongly connected part of it is on one."""
    ends = _settle(_nodes(F.col("src"), added).union(_nodes(F.col("dst"), added)).distinct())
    at = _layers_of(ends, layers, [])
    up = added.join(at.select(F.col("node").alias("src"), F.col("layer").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("layer").alias("b")), "dst").where("a <= b")
    up = write_round(up.select("src", "dst", "a"), "upward")
    least = up.agg(F.min("a")).first()[0]
    if least is None:
        return ends.frame.limit(0)
    frontier = _settle(_nodes(F.col("dst"), up))
    reached = frontier
    while not frontier.empty:
        after = _settle(_nodes(F.col("dst"), frontier.touching(edges, "src")).join(reached.side(reached.frame), "node", "left_anti"))
        frontier = _settle(_layers_of(after, layers, []).where(F.col("layer") >= least).select("node"))
        reached = _settle(reached.frame.unionByName(frontier.frame))
    within = reached.touching(reached.touching(edges, "src"), "dst").select("src", "dst")
    left = within
    for _ in range(2):  # what is on or above a cycle, and of that what is on or below one
        rest = _settle(peeled(_nodes(F.col("src"), left).withColumnRenamed("node", "id"), left).where("layer = -1").select("node"))
        if rest.empty:
            break
        left = write_round(rest.touching(rest.touching(left, "src"), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "left")
    loops = up.where("src = dst").select(F.col("src").alias("node"))
    if rest.empty:
        return loops.distinct()
    parts = strong_components(left)
    part = lambda c, name: parts.select(F.col("node").alias(c), F.col("component").alias(name))
    joined = up.join(part("src", "p"), "src").join(part("dst", "q"), "dst").where("p = q")
    return loops.unionByName(_nodes(F.col("src"), joined)).distinct()


def layers_delta(edges: DataFrame, added: DataFrame, removed: DataFrame, layers: DataFrame) -> DataFrame:
    """node, old_layer, new_layer of the nodes whose layer differs after a change.

    edges: the graph after it; added, removed: distinct edges (see edge_changes); layers: node, layer before it
    (-1 on or above a cycle), as `graph.layers` gives. A node that is in no table counts as layer 0. Layers
    are the only solution of "one more than the highest callee's" with a top for cycles, so the order in
    which nodes are corrected does not matter; new cycles are found first, as layers would rise along
    them without end. Empty changes: no rows."""
    # Sorted by caller: a scan for some callers skips the rest.
    edges = write_round(edges.select("src", "dst").distinct().repartitionByRange("src").sortWithinPartitions("src"), "edges")
    added, removed = (write_round(x.select("src", "dst"), "change") for x in (added, removed))
    stored = layers.select("node", F.when(F.col("layer") < 0, TOP).otherwise(F.col("layer")).alias("layer"))
    pinned = write_round(_on_new_cycles(edges, added, stored), "pinned")
    dirty = _settle(_nodes(F.col("src"), added).union(_nodes(F.col("src"), removed)).distinct())
    changed: list[DataFrame] = []
    for _ in count():
        if dirty.empty:
            break
        down = _settle(dirty.touching(edges, "src").select("src", F.col("dst").alias("node")))
        highest = down.frame.join(_layers_of(down, stored, changed), "node").groupBy(F.col("src").alias("node")).agg(F.max("layer").alias("highest"))
        before = _layers_of(dirty, stored, changed).withColumnRenamed("layer", "before")
        new = before.join(highest, "node", "left").join(pinned.withColumn("pin", F.lit(True)), "node", "left")
        new = new.select("node", "before", F.when(F.col("pin"), TOP).otherwise(F.least(F.coalesce(F.col("highest") + 1, F.lit(0)), F.lit(TOP))).alias("layer"))
        fresh = _settle(new.where("layer != before").select("node", "layer"))
        last = fresh.frame if not changed else fresh.frame.unionByName(changed[0].join(fresh.frame.select("node"), "node", "left_anti"))
        changed = [_settle(last).frame]  # one table of last changes
        dirty = _settle(_nodes(F.col("src"), fresh.touching(edges, "dst")))
    if not changed:
        return dirty.frame.select("node", F.lit(0).alias("old_layer"), F.lit(0).alias("new_layer"))
    every = _settle(changed[0].select("node"))
    out = lambda c, name: F.when(F.col(c) == TOP, -1).otherwise(F.col(c)).cast("int").alias(name)
    both = _layers_of(every, stored, []).withColumnRenamed("layer", "old").join(_layers_of(every, stored, changed), "node").where("old != layer")
    return both.select("node", out("old", "old_layer"), out("layer", "new_layer"))


def impact_delta(old: DataFrame, new: DataFrame, added: DataFrame, removed: DataFrame, depth: int = 3) -> DataFrame:
    """source, node, side, change: nodes that a caller of a changed edge reaches within depth (downstream) or is
    reached by (upstream) after the change only (added) or before it only (removed)."""
    seeds = write_round(_nodes(F.col("src"), added).union(_nodes(F.col("src"), removed)).distinct().select(F.col("node").alias("source"), "node"), "seeds")
    out = None
    for side, up in (("upstream", True), ("downstream", False)):
        before, after = (write_round(reach(e, seeds, depth, up).where("depth > 0").select("source", "node"), "reach") for e in (old, new))
        for change, a, b in (("added", after, before), ("removed", before, after)):
            rows = a.join(b, ["source", "node"], "left_anti").select("source", "node", F.lit(side).alias("side"), F.lit(change).alias("change"))
            out = rows if out is None else out.unionByName(rows)
    return out
