"""Mixing sources to target weights by systematic sampling. Native: DataFrame operations only.

Within a source every document expects target / source size copies. Documents stand in order of
their size class, so prefix sums of expected copies are rank * rate; one random offset for each
source is added, and a document is emitted once for each integer boundary its interval crosses.
As neighbours in that order are of nearly the same size, the words taken differ from the target
by about the largest document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, release_heaps, require

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Ranks are counted in buckets of (source, size class, salt), so that no source, however large,
#: and no size, however common, is ranked by one task.
SALTS = 64
HEX = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _class(size: Column) -> Column:
    """Sizes with the same five leading binary digits share a class: about 3 % wide."""
    digits = F.length(F.bin(size))
    return F.when(size < 32, size).otherwise(digits * 32 + F.call_function("shiftright", size, digits - 5)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target of (source, size).

    Sources by code point, null last, weigh `weights` in turn; `share` of all sizes is shared by
    weight; what a source's target has above `most` times its size goes to the others by weight
    until none is above. That fixed point is min(most * size, level * weight): sources reach their
    limit in order of size / weight, and the level after k of them is what is left over the weight
    left. The windows run over one row a source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    levels = levels.withColumn("_final", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("_w")))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long") / F.lit(float(16**HEX))


def _planned(
    docs: DataFrame, keep: list[str], seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
    salts: int = SALTS, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc (a struct of the columns in keep), size, source_size, target, copies, taken of each row."""
    require(docs, doc_id, text, source)
    release_heaps(docs.sparkSession)
    size = n_words(docs[text])
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(docs[doc_id].cast("string"), F.lit("")).cast("binary")), 1, HEX), 16, 10).cast("long"), F.lit(salts))
    ordered = [docs[source].alias("src"), size.alias("size"), _class(size).alias("class"), salt.alias("salt")]
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs[doc_id].alias("id"), *ordered)
    if text in keep:  # the counts are written, the texts are read again
        narrow = materialise(docs.select(*ordered), "sizes")
    else:
        narrow = rows = materialise(rows, "sizes")

    targets = source_targets(narrow.select(F.col("src").alias("source"), "size"), weights, share, most)
    buckets = narrow.groupBy("src", "class", "salt").agg(F.count("*").alias("n"))
    # The prefix sums run over bucket counts: at most salts * size classes rows for a source.
    ahead = Window.partitionBy("src").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    buckets = buckets.join(targets, F.col("src").eqNullSafe(F.col("source"))).select(
        F.col("src").alias("b_src"), F.col("class").alias("b_class"), F.col("salt").alias("b_salt"), "ahead", "source_size", "target"
    )
    within = Window.partitionBy("src", "class", "salt").orderBy("id", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(
        buckets, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("class") == F.col("b_class")) & (F.col("salt") == F.col("b_salt"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("ahead") + F.col("rank")
    ranked = ranked.withColumns({"rate": rate, "offset": offset(F.col("src"), seed)})
    crossed = F.floor(F.col("offset") + at * F.col("rate")) - F.floor(F.col("offset") + (at - 1) * F.col("rate"))
    copies = F.least(crossed, F.ceil(F.col("rate"))).cast("long")
    return ranked.select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: Columns that plan_mix adds.
ADDED = ("size", "source_size", "target", "copies", "taken")


def plan_mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row for each document with size, source_size, target, copies, taken.

    options: seed, weights, share, most, salts, doc_id, source. Columns: those of docs but the text, and
    the five (which replace columns of docs with such names). Null text or no words: size 0. A null
    source is a source of its own. Null ids stand first in their bucket, equal rows get their copies
    in an arbitrary order among themselves, so the multiset of rows is the same in each run. A source
    without words has target 0 and copies 0. Empty input: no rows.
    """
    keep = [c for c in docs.columns if c != text]
    planned = _planned(docs, keep, text=text, **options)
    return planned.select(*[F.col("doc").getField(c).alias(c) for c in keep if c not in ADDED], *ADDED)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, planned as by plan_mix: each row of docs as often as it was taken, with all the
    columns of docs unchanged, whatever their names."""
    planned = _planned(docs, docs.columns, **options).where("copies > 0")
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return planned.select("doc", repeats).select("doc.*")
