"""Joins beyond equality: interval stabbing and overlap, look-ahead, cascades, suffixes, rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(points: DataFrame, intervals: DataFrame, key: list[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the intervals that hold them: both meet on the key and a bin of `width`."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    right = intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(bins))
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    return left.join(right, [*key, "_bin"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_bin")


def stab_narrowest(points: DataFrame, intervals: DataFrame, key: list[str], point: str = "line", start: str = "start_line", end: str = "end_line", ident: str = "id", width: int = 256, by: list[str] | None = None) -> DataFrame:
    """For each point (its key and `by` columns) the id of the narrowest interval that holds it; ties to
    the earlier start, then the smaller id. Points in none are left out."""
    held = _binned(points, intervals, key, point, start, end, width)
    groups = [*key, point, *(by or [])]
    return held.groupBy(*groups).agg(F.min(F.struct(F.col(end) - F.col(start), F.col(start), F.col(ident))).alias("_m")).select(*groups, F.col(f"_m.{ident}").alias(ident))


def stab_first(points: DataFrame, intervals: DataFrame, key: list[str], point: str = "line", start: str = "start_line", end: str = "end_line", ident: str = "id", width: int = 256) -> DataFrame:
    """As stab_narrowest, but the interval that starts first."""
    held = _binned(points, intervals, key, point, start, end, width)
    return held.groupBy(*key, point).agg(F.min(F.struct(F.col(start), F.col(ident))).alias("_m")).select(*key, point, F.col(f"_m.{ident}").alias(ident))


def overlaps(hunks: DataFrame, intervals: DataFrame, key: list[str], a: str = "from_line", b: str = "to_line", start: str = "start_line", end: str = "end_line", width: int = 256) -> DataFrame:
    """Hunks with the intervals they overlap. A pair may share several bins: the first one counts."""
    spread = lambda df, x, y, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))))
    left, right = spread(hunks.where(F.col(a) <= F.col(b)), a, b, "_bin"), spread(intervals.where(F.col(start) <= F.col(end)), start, end, "_bin")
    meets = (F.col(start) <= F.col(b)) & (F.col(end) >= F.col(a))
    once = F.col("_bin") == F.floor(F.greatest(F.col(a), F.col(start)) / width)
    return left.join(right, [*key, "_bin"]).where(meets & once).drop("_bin")


def lookahead(changes: DataFrame, finds: DataFrame, key: str, order: str, k: int = 3) -> DataFrame:
    """Findings among the next k versions after a change; each finding counts for its first change.

    changes: key, order (all versions). finds: key, order, finding. Versions are numbered within
    the key, so gaps in `order` do not matter."""
    numbered = changes.select(key, order).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    at = finds.join(numbered, [key, order]).withColumnRenamed("_n", "_at")
    after = at.withColumn("_n", F.explode(F.sequence(F.greatest(F.col("_at") - k, F.lit(1)), F.col("_at") - 1)) if k else F.col("_at")).where("_n < _at")
    met = after.drop(order).join(numbered, [key, "_n"])
    return met.groupBy(key, "finding").agg(F.min(order).alias(f"change_{order}"))


def cascade(calls: DataFrame, strategies: list[tuple[str, DataFrame, list[str]]], unresolved: int = 0) -> DataFrame:
    """calls plus callee_id and method: the first strategy that has an answer wins.

    strategies: (name, table with a column id and one row for each key, key columns). One left join
    each; a table with several ids for a key has to be reduced to the smallest or to unique ones."""
    out, picks = calls, []
    for i, (name, table, keys) in enumerate(strategies):
        right = table.select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.col("id").alias(f"_id{i}"))
        on: Column = F.lit(True)
        for k in keys:
            on = on & (F.col(k) == F.col(f"_k{i}_{k}"))
        out = out.join(right, on, "left")
        picks.append((name, F.col(f"_id{i}")))
    method = F.lit("unresolved")
    for name, ident in reversed(picks):
        method = F.when(ident.isNotNull(), name).otherwise(method)
    return out.select(*calls.columns, F.coalesce(*[x for _, x in picks], F.lit(unresolved)).alias("callee_id"), method.alias("method"))


def unique_by(table: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """Keys that exactly one id has."""
    return table.groupBy(*keys).agg(F.min(ident).alias("id"), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def least_by(table: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    return table.groupBy(*keys).agg(F.min(ident).alias("id"))


def suffix_match(paths: DataFrame, files: DataFrame, path: str = "path", file: str = "file", ident: str = "id", separator: str = "/") -> DataFrame:
    """paths with the id of a file one of which ends with the other, at a separator: equal ones first,
    then the longest common suffix, then the smallest id.

    Each file gives all suffixes of its path, each path all of its own. Per suffix only the smallest id of the files
    that end so, and of those that are it, are kept, so a name that a million files have is one row, and no
    path meets more rows than it has segments."""
    def suffixes(c: str) -> Column:
        parts = F.split(F.col(c), F.lit(f"\\Q{separator}\\E"), -1)
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator)))

    known = files.where(F.col(file).isNotNull()).select(F.col(file).alias("_file"), F.col(ident).alias("_id"))
    asked = paths.where(F.col(path).isNotNull()).select(path).distinct()
    whole = known.groupBy(F.col("_file").alias("_suffix")).agg(F.min("_id").alias("_id"))
    ending = known.select(suffixes("_file").alias("_suffix"), "_id").groupBy("_suffix").agg(F.min("_id").alias("_id"))
    rank = lambda equal, length: F.struct((~equal).alias("d"), (-length).alias("l"), F.col("_id").alias("i")).alias("_rank")
    longer = asked.withColumn("_suffix", F.col(path)).join(ending, "_suffix").select(path, rank(F.lit(False), F.length("_suffix")))
    shorter = asked.select(path, suffixes(path).alias("_suffix")).join(whole, "_suffix").select(path, rank(F.col("_suffix") == F.col(path), F.length("_suffix")))
    return longer.unionByName(shorter).groupBy(path).agg(F.min("_rank").alias("_m")).select(path, F.col("_m.i").alias(ident))


GLOB = re.compile(r"(?P<escaped>\\.)|(?P<class>\[[!^]?\]?[^\]]*\])|(?P<deep>\*\*/)|(?P<all>\*\*)|(?P<star>\*)|(?P<one>\?)|(?P<plain>.)", re.S)


def glob_to_regex(pattern: str) -> str:
    """Of an ignore-file pattern: ** crosses separators, * and ? do not; [a-z] and [!a] are classes, \\ takes
    the next character as it is; a separator but the last anchors, one at the end asks for a directory."""
    directory = pattern.endswith("/") and not pattern.endswith("\\/")
    anchored = "/" in pattern.rstrip("/")

    def part(m: re.Match) -> str:
        kind, found = m.lastgroup, m[0]
        if kind == "class":
            inner = found[1:-1].replace("\\", "\\\\").replace("[", "\\[")
            return f"[^/{inner[1:]}]" if inner[:1] in ("!", "^") else f"[{inner}]"
        wild = {"deep": "(.*/)?", "all": ".*", "star": "[^/]*", "one": "[^/]"}
        return wild.get(kind) or re.escape(found[-1])

    body = GLOB.sub(part, pattern.strip("/"))
    return ("^" if anchored else "(^|/)") + body + ("/" if directory else "(/|$)")


def last_rule(items: DataFrame, rules: DataFrame, item: str = "path", value: str = "owner") -> DataFrame:
    """items with the value of the last rule (idx, pattern as a regular expression, value) that matches;
    null if none does. Rules are few and stand in one row, in order: no join of items with rules."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("idx"), F.col("pattern"), F.col(value).alias("value"))), asc=False)
    held = rules.agg(ordered.alias("_rules"))
    hit = F.filter("_rules", lambda r: F.regexp_like(F.col(item), r["pattern"]))
    return items.crossJoin(F.broadcast(held)).select(*items.columns, F.get(hit, F.lit(0))["value"].alias(value))  # one row


def is_ignored(items: DataFrame, patterns: list[str], item: str = "path") -> DataFrame:
    """items plus ignored, by an ignore file's lines: the last match decides, '!' takes back."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if line and not line.startswith("#"):
            out = F.when(F.col(item).rlike(glob_to_regex(line.removeprefix("!"))), F.lit(not line.startswith("!"))).otherwise(out)
    return items.withColumn("ignored", out)
