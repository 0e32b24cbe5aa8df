"""Aggregations, rankings and scores over entity, coverage, change and finding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ratio


def stats(df: DataFrame, **conditions: Column) -> DataFrame:
    """total and one count for each named condition, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def status(manifest: DataFrame, listing: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """state, n of files: new, deleted, stale or fresh."""
    both = manifest.select(key, F.col(hash_).alias("_old"), F.lit(1).alias("_a")).join(listing.select(key, F.col(hash_).alias("_new"), F.lit(1).alias("_b")), key, "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "fresh").otherwise("stale")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def entity_coverage(lines: DataFrame) -> DataFrame:
    """entity, tracked, covered, pct, uncovered (sorted lines) of (entity, line, hits)."""
    miss = F.when(F.col("hits") == 0, F.col("line"))
    return lines.groupBy("entity").agg(
        F.count("*").alias("tracked"),
        F.count_if(F.col("hits") > 0).alias("covered"),
        ratio(F.count_if(F.col("hits") > 0) * 100, F.count("*"), 2).alias("pct"),
        F.array_sort(F.collect_list(miss)).alias("uncovered"),
    )


def uncovered(lines: DataFrame, below: float) -> DataFrame:
    return entity_coverage(lines).where((F.col("tracked") > 0) & (F.col("pct") < below)).select("entity", "tracked", "covered", "pct")


def grouped_ratio(df: DataFrame, keys: list[str], entity: Column, hit: Column) -> DataFrame:
    """Distinct entities, distinct entities with a hit, and their ratio in each group."""
    n, k = F.countDistinct(entity), F.countDistinct(F.when(hit, entity))
    return df.groupBy(*keys).agg(n.alias("total"), k.alias("hits"), ratio(k, n).alias("ratio"))


def frequency(changes: DataFrame, keys: list[str], ts: str = "ts", author: str = "author") -> DataFrame:
    """n, first_seen, last_seen, authors, avg_interval_s of each key's changes; ts in seconds."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return changes.withColumn("_gap", F.col(ts) - before).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.countDistinct(author).alias("authors"), F.round(F.avg("_gap"), 2).alias("avg_interval_s"),
    )


def monday_week(ts: Column) -> Column:
    """The week number whose weeks begin on Monday; days before the first Monday are week 0."""
    return F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def histogram(changes: DataFrame, ts: str = "ts") -> DataFrame:
    """grain, bucket, n by day, week and month, from one scan."""
    at = F.col(ts)
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), F.date_format(at, "yyyy-MM-dd").alias("bucket")),
        F.struct(F.lit("week").alias("grain"), F.format_string("%s-W%02d", F.date_format(at, "yyyy"), monday_week(at)).alias("bucket")),
        F.struct(F.lit("month").alias("grain"), F.date_format(at, "yyyy-MM").alias("bucket")),
    )
    return changes.select(F.explode(grains).alias("g")).groupBy("g.grain", "g.bucket").agg(F.count("*").alias("n"))


def churn(changes: DataFrame, sizes: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """churn (added + deleted) and its rate to the present size, the largest first."""
    sums = changes.groupBy(*keys).agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    rated = sums.join(sizes, keys, "left").withColumn("rate", ratio(F.col("churn"), F.col("size")))
    return rated.orderBy(F.col("churn").desc(), *keys).limit(top).select(*keys, "churn", "rate")


def size_churn(versions: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """churn without line counts: the sum of the differences between consecutive sizes."""
    change = F.abs(F.col(size) - F.lag(size).over(Window.partitionBy(key).orderBy(order)))
    return versions.withColumn("_d", change).groupBy(key).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("churn"), F.count("*").alias("n_versions"))


def hotspots(metrics: DataFrame, weights: dict[str, float], key: str = "entity") -> DataFrame:
    """score: the weighted sum of the metrics, each over its maximum. The maxima are one row."""
    most = F.broadcast(metrics.agg(*[F.max(c).alias(f"_max_{c}") for c in weights]))
    parts = [F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_max_{c}").cast("double")), F.lit(0.0)) * w for c, w in weights.items()]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return metrics.crossJoin(most).select(key, *weights, F.round(total, 4).alias("score"))  # one row


def hotspot_label(changes: Column, days: Column) -> Column:
    """persistent: more than 5 changes, the last in 30 days; emerging: 3 to 5, the last in 7 days; else null."""
    return F.when((changes > 5) & (days <= 30), "persistent").when(changes.between(3, 5) & (days <= 7), "emerging")


def stability(runs: DataFrame, test: str, ts: str, last: int = 50, tie: str | None = None) -> DataFrame:
    """n, passed, pass_rate, avg_ms over the last runs of each test (status, duration)."""
    order = [F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])]
    recent = runs.withColumn("_n", F.row_number().over(Window.partitionBy(test).orderBy(*order))).where(F.col("_n") <= last)
    ok = F.count_if(F.col("status") == "passed")
    return recent.groupBy(test).agg(F.count("*").alias("n"), ok.alias("passed"), ratio(ok, F.count("*")).alias("pass_rate"), F.round(F.avg("duration"), 3).alias("avg_ms"))


def levels(value: Column, *steps: tuple[float, str], other: str = "ok") -> Column:
    """The label of the first limit that value reaches; limits from the highest down."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(value >= limit, name)
    return out.otherwise(other)


def health(counts: DataFrame, high: str = "high", medium: str = "medium", low: str = "low") -> DataFrame:
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.col(high) * 5 - F.col(medium) * 2 - F.col(low) * 0.5)
    return counts.withColumn("score", score).withColumn("level", levels(score, (90, "excellent"), (70, "good"), (50, "fair"), other="poor"))


# Lowest sizes of the severities high, medium and low by category.
HEALTH_LIMITS = {"large_files": (2000, 1000, 500), "complex_functions": (30, 20, 10), "long_functions": (200, 100, 50)}


def health_frames(measured: dict[str, DataFrame], limits: dict[str, tuple] = HEALTH_LIMITS) -> DataFrame:
    """category, item, value, severity of what reaches a limit, of (item, value) by category."""
    out = None
    for category, rows in measured.items():
        high, medium, low = limits[category]
        value = F.col("value")
        severity = levels(value, (high, "high"), (medium, "medium"), other="low")
        found = rows.where(value >= low).select(F.lit(category).alias("category"), F.col("item").cast("string").alias("item"), value.cast("long").alias("value"), severity.alias("severity"))
        out = found if out is None else out.unionByName(found)
    return out


# Above the first a risk, above the second a high one; the classes without are always so.
RISK_LIMITS = {"high_complexity": (20, 30), "oversized_function": (500, 1000)}
RISK_ALWAYS = {"blocking_finding": "high", "broken_audit": "high", "db_stale": "medium"}


def risks(classes: dict[str, DataFrame], top: int = 15) -> DataFrame:
    """type, severity, item, value of (item, value) by class: the `top` largest of each, high ones first."""
    out = None
    for name, rows in classes.items():
        if name in RISK_LIMITS:
            some, high = RISK_LIMITS[name]
            rows, severity = rows.where(F.col("value") > some), F.when(F.col("value") > high, "high").otherwise("medium")
        else:
            severity = F.lit(RISK_ALWAYS[name])
        found = rows.select(F.lit(name).alias("type"), severity.alias("severity"), F.col("item").cast("string").alias("item"), F.col("value").cast("long").alias("value"))
        found = found.orderBy(F.desc("value"), "item").limit(top)
        out = found if out is None else out.unionByName(found)
    return out.orderBy(F.col("severity") != "high", "type", F.desc("value"), "item")


def savings(df: DataFrame, key: str, amount: str, pct: str) -> DataFrame:
    """Sum, count and mean by key and over all (key null), in one pass with rollup."""
    return df.rollup(key).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("saved"), F.round(F.avg(pct), 4).alias("avg_pct"), F.grouping(key).cast("int").alias("is_total"))


def percentiles(df: DataFrame, value: str, keys: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.percentile(value, F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in at])


def ownership(df: DataFrame, module: str, owner: str) -> DataFrame:
    """module, owners, files, primary_owner (the one with most files, ties to the first name)."""
    each = df.groupBy(module, owner).agg(F.count("*").alias("_n"))
    return each.groupBy(module).agg(F.count("*").alias("owners"), F.sum("_n").alias("files"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(owner).alias("o"))).alias("_m")).select(module, "owners", "files", F.col("_m.o").alias("primary_owner"))


def patterns(findings: DataFrame) -> DataFrame:
    """Defect patterns: findings by rule with the most severe one and the number of cases."""
    rank = F.when(F.col("severity") == "ERROR", 3).when(F.col("severity") == "WARNING", 2).otherwise(1)
    named = F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("ERROR")), F.max(rank))
    return findings.groupBy("rule").agg(F.count("*").alias("cases"), named.alias("severity"), F.countDistinct("user_id").alias("users"))


def suggest(fixes: DataFrame, cases: DataFrame, top: int = 5) -> DataFrame:
    """rule, confidence: the mean effectiveness of a rule's best fixes (rule, fix, effectiveness), without
    any min(0.5, 0.05 * cases)."""
    best = F.row_number().over(Window.partitionBy("rule").orderBy(F.col("effectiveness").desc(), "fix"))
    mean = fixes.withColumn("_n", best).where(F.col("_n") <= top).groupBy("rule").agg(F.avg("effectiveness").alias("_e"), F.count("*").alias("n_fixes"))
    return cases.join(mean, "rule", "left").select("rule", F.coalesce("n_fixes", F.lit(0)).alias("n_fixes"), F.round(F.coalesce("_e", F.least(F.lit(0.5), F.col("cases") * 0.05)), 4).alias("confidence"))


def zero_filled(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts of the categories, those that do not occur included."""
    every = df.sparkSession.createDataFrame([(c,) for c in categories], f"`{column}` string")
    return every.join(df.groupBy(column).agg(F.count("*").alias("_n")), column, "left").select(column, F.coalesce("_n", F.lit(0)).alias("n"))


def _fits(value: str):
    return lambda x: (x == value) | (F.endswith(x, F.lit("*")) & F.startswith(F.lit(value), F.rtrim(x, F.lit("*"))))


def scope_matches(rules: DataFrame, given: dict[str, str]) -> DataFrame:
    """Rules whose scope (JSON: field -> list of values, '*' and prefixes 'x*' allowed) fits: one value of
    each field, all fields, nothing in scope fits all; with specificity, the most specific first."""
    schema = ", ".join(f"`{k}` array<string>" for k in given)
    parsed = rules.withColumn("_scope", F.from_json("scope", schema))
    fits, special = F.lit(True), F.lit(0)
    for name, value in given.items():
        values = F.col("_scope")[name]
        empty = values.isNull() | (F.size(values) == 0)
        one = F.exists(values, _fits(value))
        fits = fits & (empty | one)
        special = special + F.when(empty, 0).otherwise(1)
    return parsed.where(fits).withColumn("specificity", special).drop("_scope")
