"""Spans of definitions in languages with braces, by nesting depth.

A text's strings, comments, definitions, braces, semicolons and line ends are rows in order; what stands
in a string or comment is one of these and counts for nothing. Depth is a running sum of braces, and a
definition's span ends with the next brace that closes its own depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Languages whose strings can have single quotes; in others these hold one character, or begin a lifetime.
QUOTED = ("javascript", "typescript", "php", "vue")
BRACES = ("javascript", "typescript", "php", "vue", "java", "go", "rust", "c", "cpp", "csharp", "kotlin", "swift", "scala")

_LIST = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: A keyword and a name with its parameters, or a name and its parameters before a brace.
_NAMED = rf"\b(?:fn|func|function|fun|class|struct|interface|trait|enum|impl|object|protocol|record)\s+(?:{_LIST}\s*)?[A-Za-z_]\w*(?:\s*{_LIST})?"
_BODIED = rf"\b(?!(?:if|for|while|switch|catch|match|return|synchronized|with|when|using|lock|else|do|try|new)\b)[A-Za-z_]\w*\s*{_LIST}\s*(?:const\s*|noexcept\s*|override\s*|throws\s[\w.,\s]+?)*(?=\{{)"
_NAME = r"^(?:(?:fn|func|function|fun|class|struct|interface|trait|enum|impl|object|protocol|record)\s+(?:\(.*?\)\s*)?)?([A-Za-z_]\w*)"


def _pattern(single: str) -> str:
    return rf'"(?:\\.|[^"\\\n])*"|{single}|`[^`]*`|//[^\n]*|(?s:/\*.*?\*/)|{_NAMED}|{_BODIED}|[{{}};\n]'


def block_spans(texts: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """key, name, depth, start_line, end_line of the definitions that have a body in braces.

    language: a column that tells whether single quotes hold strings (see QUOTED). Keys are unique. Null texts
    have no definitions; a body that is never closed ends with its text. Rows are tokens, and only those of
    one text meet in a window."""
    quotes = F.col(language).isin(*QUOTED) if language else F.lit(False)
    tokens = F.when(quotes, F.regexp_extract_all(text, F.lit(_pattern(r"'(?:\\.|[^'\\\n])*'")), 0)).otherwise(F.regexp_extract_all(text, F.lit(_pattern(r"'(?:\\[^']+|[^'\\\n])'")), 0))
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(tokens).alias("at", "token"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("last_line"))
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    kind = F.when(F.col("token").isin("{", "}", ";", "\n"), F.col("token")).when(F.col("token").rlike(r"^[A-Za-z_]"), "def").otherwise("text")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    rows = rows.withColumns({"kind": kind, "breaks": breaks, "step": step})
    order = Window.partitionBy(key).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"line": 1 + F.coalesce(F.sum("breaks").over(before), F.lit(0)), "depth": F.coalesce(F.sum("step").over(before), F.lit(0))})
    # A block's braces and the definition before it have one depth: that outside the block.
    rows = rows.where("kind in ('{', '}', ';', 'def')").withColumn("depth", F.when(F.col("kind") == "}", F.col("depth") - 1).otherwise(F.col("depth")))
    after = Window.partitionBy(key, "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    following = lambda *kinds, value="at": F.min(F.when(F.col("kind").isin(*kinds), F.col(value))).over(after)
    rows = rows.withColumns({"opens": following("{"), "other": following(";", "def"), "end": following("}", value="line")})
    defined = rows.where("kind = 'def' and opens is not null and (other is null or opens < other)")
    name = F.regexp_extract("token", _NAME, 1)
    return defined.select(key, name.alias("name"), F.col("depth").cast("int").alias("depth"), F.col("line").cast("int").alias("start_line"), F.coalesce("end", "last_line").cast("int").alias("end_line"))


def with_block_ends(facts: DataFrame, files: DataFrame) -> DataFrame:
    """What `sources.code.parse_tree` found, its symbols of languages with braces ending where their block does.
    files: hash, language, content."""
    once = files.where(F.col("language").isin(*BRACES)).dropDuplicates(["hash", "language"]).withColumn("_file", F.concat_ws("|", "language", "hash"))
    spans = block_spans(once.select("_file", "content", "language"), "_file", "content", "language")
    ends = spans.groupBy("_file", "name", "start_line").agg(F.max("end_line").alias("_end"))
    keyed = facts.withColumn("_file", F.when(F.col("fact") == "symbol", F.concat_ws("|", "language", "hash")))
    return keyed.join(ends, ["_file", "name", "start_line"], "left").withColumn("end_line", F.coalesce("_end", "end_line")).select(*facts.columns)
