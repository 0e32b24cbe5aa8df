"""URL filters: allow and block rules joined on short hash prefixes.

Each URL becomes the expressions (host suffix + path prefix) that a rule could have; expressions
and rules meet on the first 32 bits of their SHA-256, full digests confirm, and the longest rule
decides. Only suffix and prefix lengths that some rule has are expanded, so the number of
expressions of a URL depends on the rules, not on the URL's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules up to this number are broadcast (about 200 bytes each); beyond it the join is shuffled.
BROADCAST_RULES = 100_000
SALTS = 16
PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return (
        F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def _digested(df: DataFrame, expression: str) -> DataFrame:
    return df.withColumn("_digest", F.sha2(F.col(expression), 256)).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX_HEX)
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """pages plus host, path, rule and verdict.

    rules: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains of it
    if the URL's path starts with its path. The longest rule (host and path together, then host)
    wins; equal rules that disagree block. Rules with a null or empty host fit nothing, a null path
    is an empty one. No rule: rule is null and verdict is `default`. Every input row gives one row,
    repeated rows too; columns named host, path, rule or verdict in pages are replaced, others, of any
    name and type, come through as they are. An empty
    table of pages or rules is no special case.
    """
    require(pages, url)
    require(rules, "host", "path", "verdict")
    host, path = url_parts(pages[url])
    new = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in new]
    # The row in one column: no name of pages can clash with those used here.
    pages = pages.select(F.struct(*[pages[c] for c in own]).alias("_page"), host.alias("_host"), path.alias("_path"))

    rules = (
        rules.select(
            F.translate(F.col("host"), UPPER, UPPER.lower()).alias("_rule_host"),
            F.coalesce("path", F.lit("")).alias("_rule_path"),
            F.col("verdict").alias("_verdict"),
        )
        .where("_rule_host != ''")
        .groupBy("_rule_host", "_rule_path")
        .agg(F.max("_verdict").alias("_verdict"))  # 'block' > 'allow'
        .withColumn("_rule", F.concat("_rule_host", "_rule_path"))
    )
    rules = _digested(rules, "_rule")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("_rule_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("_rule_path"))).alias("lengths"),
    ).first()  # lengths only: some hundreds of numbers for any rule table

    labels = F.filter(F.lit(shape["labels"] or [0]), lambda k: k <= F.size(F.split("_host", r"\.")))
    lengths = F.filter(F.lit(shape["lengths"] or [0]), lambda n: n <= F.length("_path"))
    urls = (
        pages.select("_host", "_path")
        .where("_host != ''")
        .distinct()
        .withColumns(
            {
                "_suffixes": F.transform(labels, lambda k: F.call_function("substring_index", F.col("_host"), F.lit("."), -k)),
                "_prefixes": F.transform(lengths, lambda n: F.substr(F.col("_path"), F.lit(1), n)),
            }
        )
        .withColumn("_suffix", F.explode("_suffixes"))
        .select("_host", "_path", F.explode(F.transform("_prefixes", lambda p: F.concat("_suffix", p))).alias("_expression"))
    )
    urls = _digested(urls, "_expression").drop("_expression")

    wanted = rules.select("_prefix", F.col("_digest").alias("_rule_digest"), "_rule", "_rule_host", "_verdict")
    if shape["n"] <= broadcast_rules:
        met = urls.join(F.broadcast(wanted), "_prefix")
    else:  # a rule such as a whole top-level domain fits a large share of all URLs: deal it out
        salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = urls.withColumn("_salt", F.pmod(F.xxhash64("_host", "_path"), F.lit(SALTS)).cast("int")).join(salted, ["_prefix", "_salt"])
    best = F.max(F.struct(F.length("_rule"), F.length("_rule_host"), "_rule", "_verdict")).alias("_best")
    verdicts = met.where("_digest = _rule_digest").groupBy("_host", "_path").agg(best)

    return pages.join(verdicts, ["_host", "_path"], "left").select(
        *[F.col("_page").getField(c).alias(c) for c in own],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"),
    )
