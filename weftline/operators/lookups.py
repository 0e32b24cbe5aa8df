"""Look-ups in registries and histories: the first row of a key in a stated order, the newest of many,
groups with their members, counts with categories that nobody has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ratio


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in the order: a minimum, which is taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def newest(changes: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The top changes of each key with their rank."""
    return changes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)


def latest_commented(versions: DataFrame, key: str, order: str, comment: str) -> DataFrame:
    """key, the last version with a comment, and that comment."""
    some = versions.where(F.col(comment).isNotNull() & (F.trim(comment) != ""))
    return some.groupBy(key).agg(F.max(F.struct(order, comment)).alias("_m")).select(key, f"_m.{order}", f"_m.{comment}")


def counts_by(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """category, n; zero for those without rows. Categories are given, a handful."""
    frame = df.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    found = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return F.broadcast(frame).join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def registry(workspaces: DataFrame, symbols: DataFrame, key: str, active: Column) -> DataFrame:
    """workspaces with n_symbols and is_active."""
    n = symbols.groupBy(key).agg(F.count("*").alias("n_symbols"))
    return workspaces.join(n, key, "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))).withColumn("is_active", active)


def group_members(rows: DataFrame, by: str, clone_type: int, key: str = "id") -> DataFrame:
    """group_hash, clone_type, representative, member: one row a member, so that no group is gathered."""
    groups = rows.groupBy(by).agg(F.count("*").alias("_n"), F.min(key).alias("representative")).where("_n > 1")
    name = F.substring(F.sha2(F.concat(F.lit(f"{clone_type}:"), F.col(by)), 256), 1, 16)
    return rows.join(groups, by).select(name.alias("group_hash"), F.lit(clone_type).alias("clone_type"), "representative", F.col(key).alias("member"))


def savings(df: DataFrame, original: str, actual: str) -> DataFrame:
    """df with saved and saved_pct; what costs more saves nothing."""
    saved = F.greatest(F.col(original) - F.col(actual), F.lit(0))
    return df.withColumns({"saved": saved, "saved_pct": ratio(saved * 100, F.col(original), 2)})


def freshness(artifacts: DataFrame, providers: DataFrame, key: str, built_from: str, revision: str) -> DataFrame:
    """key, state: fresh if the artifact was built from the provider's present revision, stale if from another,
    orphaned without a provider."""
    both = artifacts.select(key, built_from).join(providers.select(key, revision), key, "left")
    state = F.when(F.col(revision).isNull(), "orphaned").when(F.col(built_from).eqNullSafe(F.col(revision)), "fresh").otherwise("stale")
    return both.select(key, state.alias("state"))


def blame_owners(lines: DataFrame, file: str, author: str, ts: str) -> DataFrame:
    """file, owner (the last to change a line; ties: the first name), confidence (the owner's share of lines)."""
    each = lines.groupBy(file, author).agg(F.count("*").alias("_n"), F.max(ts).alias("_t"))
    last = each.groupBy(file).agg(F.min(F.struct((-F.unix_micros(F.col("_t").cast("timestamp"))).alias("_t"), F.col(author).alias("owner"), "_n")).alias("_m"), F.sum("_n").alias("_all"))
    return last.select(file, "_m.owner", ratio(F.col("_m._n"), F.col("_all")).alias("confidence"))


def finding_risk(severity: Column, reached: Column) -> Column:
    """Of a finding and the number of nodes that it reaches."""
    return (
        F.when((severity == "ERROR") & (reached > 10), "critical").when((severity == "ERROR") & (reached > 3), "high").when(severity == "WARNING", "medium").otherwise("low")
    )


def top_counts(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """dimension, value, n: the most frequent values of each column, from one scan."""
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    counted = df.select(F.explode(each).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
