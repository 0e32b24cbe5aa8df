"""Histograms of fixed buckets that add up: over tasks, windows, streams and tables of histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the buckets, in seconds for latencies; a last bucket has what lies above.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _checked(bounds: Sequence[float]) -> list[float]:
    if not bounds or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("bounds must rise")
    return [float(b) for b in bounds]


def observe(rows: DataFrame, value: str, *by: str | Column, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """by, counts (of each bucket and of what lies above), total, n. Null and NaN values do not count. An
    aggregate of counts and sums: combined before the shuffle, and for streams in update mode with a
    window among `by`."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    ends = _checked(bounds)
    inside = [v <= ends[0], *[(v > a) & (v <= b) for a, b in zip(ends, ends[1:], strict=False)], v > ends[-1]]
    counts = F.array(*[F.count_if(x) for x in inside])
    return rows.groupBy(*by).agg(counts.alias("counts"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"))


def merge(parts: DataFrame, *by: str | Column, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """The histograms of the same bounds by fewer or coarser columns: their sums."""
    counts = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(len(_checked(bounds)) + 1)])
    return parts.groupBy(*by).agg(counts.alias("counts"), F.sum("total").alias("total"), F.sum("n").alias("n"))


def _running(counts: Column) -> Column:
    return F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x))


def percentile(share: float, bounds: Sequence[float] = BOUNDS) -> Column:
    """An estimate from counts and n, linear within its bucket: the true percentile lies in that bucket, so the error
    is less than its width. Above the last bound: that bound. Null without values."""
    ends = _checked(bounds)
    running, rank = _running(F.col("counts")), F.col("n") * share
    at = F.size(F.filter(running, lambda c: c < rank))
    array = F.array(*map(F.lit, ends))
    low = F.when(at == 0, F.lit(min(0.0, ends[0]))).otherwise(F.get(array, at - 1))
    before = F.when(at == 0, F.lit(0)).otherwise(F.get(running, at - 1))
    inside = low + (F.get(array, at) - low) * F.try_divide(rank - before, F.get("counts", at))
    return F.when(F.col("n") > 0, F.when(at >= len(ends), F.lit(ends[-1])).otherwise(inside))


def buckets(histograms: DataFrame, *by: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """by, le, n: how many values are at most le; the last le is infinity."""
    ends = F.array(*[F.lit(b) for b in _checked(bounds)], F.lit(float("inf")))
    return histograms.select(*by, F.explode(F.arrays_zip(ends.alias("le"), _running(F.col("counts")).alias("n"))).alias("b")).select(*by, "b.le", "b.n")
