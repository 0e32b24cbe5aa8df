"""Context for a question: the texts nearest to it, with who calls them and whom they call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import topk

#: Roles in the order in which a seed's neighbours follow it.
ROLES = ("seed", "caller", "callee")


def question_context(
    vectors: DataFrame, question: list[float], texts: DataFrame, edges: DataFrame, k: int = 5, callers: int = 2, callees: int = 1, most: int = 16_000,
    key: str = "vec_id", embedding: str = "embedding", node: str = "node", text: str = "text", threshold: float = -1.0,
) -> DataFrame:
    """place, node, role, seed, score, text, truncated: blocks of a context of at most `most` characters.

    Seeds are the k nearest of the vectors; after each come the smallest of its callers, then of its
    callees, each node once, where it comes first. Blocks are taken in that order as long as their
    characters fit; truncated tells whether one did not. Nodes without a text are left out. All tables but
    vectors, texts and edges have at most k times (1 + callers + callees) rows."""
    seeds = topk(vectors, question, k, threshold, key, embedding)
    nth = F.row_number().over(Window.orderBy(F.col("score").desc(), key))  # k rows
    seeds = seeds.withColumn("rank", nth).select(F.col(key).alias("seed"), "score", "rank")
    asked = F.broadcast(seeds)  # k rows

    def beside(at: str, other: str, role: int, some: int) -> DataFrame:
        near = edges.where("src != dst").join(asked, F.col(at) == F.col("seed")).groupBy("seed", "rank", "score", F.col(other).alias(node)).agg(F.count("*").alias("_calls"))
        first = F.row_number().over(Window.partitionBy("seed").orderBy(node))
        return near.withColumn("_n", first).where(F.col("_n") <= some).select("seed", "rank", "score", node, F.lit(role).alias("role"))

    blocks = seeds.select("seed", "rank", "score", F.col("seed").alias(node), F.lit(0).alias("role")).unionByName(beside("dst", "src", 1, callers)).unionByName(beside("src", "dst", 2, callees))
    once = F.row_number().over(Window.partitionBy(node).orderBy("rank", "role"))
    blocks = blocks.withColumn("_once", once).where("_once = 1").drop("_once")
    found = texts.where(F.length(text) > 0).join(F.broadcast(blocks), node).select("rank", "role", "seed", "score", node, text)
    order = Window.orderBy("rank", "role", node)
    total = F.sum(F.length(text)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = found.withColumns({"_total": total, "place": F.row_number().over(order)})
    over = F.coalesce(F.max("_total").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > most, F.lit(False))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)
    return placed.withColumn("truncated", over).where(F.col("_total") <= most).select("place", node, role.alias("role"), "seed", "score", text, "truncated")
