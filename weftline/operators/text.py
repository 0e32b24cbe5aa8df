"""Search, metrics and rules over source text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import stab_narrowest

# Control words and operators that each add one path, as regular expressions. '&&' and '||'
# count only where word characters touch them. Languages with ternaries, and comprehensions of Python.
BRANCHES = (
    r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bmatch\b",
    r"\bcase\b", r"\bcatch\b", r"\b&&\b", r"\b\|\|\b",
    r"\btry\b", r"\bexcept\b", r"\bfinally\b",
    r"\bwhen\b", r"\bguard\b",
)
TERNARY, TERNARY_LANGUAGES = r"\?\s*[^:]+\s*:", ("rust", "c", "java", "typescript", "javascript", "go")
COMPREHENSION = r"(?d)\bfor\b.*\bin\b"


def complexity(text: Column, language: Column | None = None) -> Column:
    """1 plus the branches in text, plus ternaries or comprehensions if the language has them; 1 for null."""
    out = F.lit(1)
    for pattern in BRANCHES:
        out = out + F.regexp_count(text, F.lit(pattern))
    if language is not None:
        out = out + F.when(language.isin(*TERNARY_LANGUAGES), F.regexp_count(text, F.lit(TERNARY))).when(language == "python", F.regexp_count(text, F.lit(COMPREHENSION))).otherwise(0)
    return F.coalesce(out, F.lit(1)).cast("long")


def search(df: DataFrame, query: str, columns: list[str], limit: int, *order) -> DataFrame:
    """Rows of which each query token of three letters or more occurs in some column, ignoring case;
    if the query has no such token, rows that hold the whole query."""
    tokens = [t for t in re.findall(r"[A-Za-z0-9_]+", query) if len(t) >= 3]
    hit = F.lit(True)
    for token in tokens or [query]:
        some = F.lit(False)
        for c in columns:
            some = some | F.contains(F.lower(F.col(c)), F.lit(token.lower()))
        hit = hit & some
    return df.where(hit).orderBy(*order).limit(limit)


def trigram_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """gram, key: an index for search at scale, written partitioned by gram hash by the caller."""
    # Characters as an array of their own: taking substrings would read a text from its start for each gram.
    rows = df.where(F.length(column) >= 3).select(key, F.split(F.lower(F.col(column)), "").alias("_c"))
    grams = F.transform(F.sequence(F.lit(0), F.size("_c") - 3), lambda i: F.concat(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2)))
    return rows.select(key, F.explode(F.array_distinct(grams)).alias("gram"))


def search_index(index: DataFrame, query: str, key: str) -> DataFrame:
    """Keys whose indexed text holds every trigram of the query's tokens: a superset to be confirmed."""
    grams = sorted({t.lower()[i : i + 3] for t in re.findall(r"[A-Za-z0-9_]+", query) for i in range(len(t) - 2)})
    return index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.countDistinct("gram").alias("_n")).where(F.col("_n") == len(grams)).select(key)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def grep(df: DataFrame, key: str, text: str, patterns: list[str], limit: int = 5000) -> DataFrame:
    """Lines that all patterns match; the document is tested first, so most texts are never split."""
    for p in patterns:
        df = df.where(F.col(text).rlike(p))
    rows = text_lines(df, key, text)
    for p in patterns:
        rows = rows.where(F.col("content").rlike(p))
    return rows.orderBy(key, "line").limit(limit)


def enclosing(matches: DataFrame, symbols: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """matches (file, line, ...) plus symbol and kind: the narrowest of symbols (file, id, kind, start_line,
    end_line) around the line, null outside of all; kinds: only matches in a symbol of these kinds."""
    held = stab_narrowest(matches.select("file", "line").distinct(), symbols, ["file"])
    named = held.join(symbols.select("file", "id", "kind").distinct(), ["file", "id"]).withColumnRenamed("id", "symbol")
    out = matches.join(named, ["file", "line"], "left")
    return out.where(F.col("kind").isin(kinds)) if kinds is not None else out


# Issue rules (key, severity, pattern) for all languages and by language.
COMMON_ISSUES = (
    ("todo_fixme", "warn", r"\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b"),
    ("hardcoded_path", "warn", r'"(?:src|docs|scripts|tests|target|\.cargo|\.git|/tmp/|/usr/|/etc/|C:\\|/home/)[/\w\-\.\\]*"'),
    ("hardcoded_url", "info", r'"https?://[^\s"]+"'),
    ("magic_number", "info", r"\b\d{4,}\b"),
)
RUST_ISSUES = (
    ("unwrap_call", "danger", r"\.unwrap\(\)"),
    ("expect_call", "warn", r"\.expect\("),
    ("panic_macro", "danger", r"\bpanic!\(|\bunimplemented!\(|\btodo!\(\)"),
    ("unsafe_block", "warn", r"\bunsafe\s*\{|\bunsafe\s+fn\b|\bunsafe\s+impl\b"),
    ("clone_heavy", "info", r"\.clone\(\)"),
)
TYPESCRIPT_ISSUES = (
    ("any_type", "warn", r":\s*any\b|\bas\s+any\b"),
    ("console_log", "info", r"console\.(log|error|warn|debug)\("),
    ("ts_ignore", "warn", r"@ts-ignore|@ts-nocheck"),
    ("non_null_assertion", "warn", r"\w!\s*[.\(\)]"),
)
PYTHON_ISSUES = (
    ("bare_except", "danger", r"except\s*:"),
    ("print_debug", "info", r"\bprint\("),
    ("broad_except", "warn", r"except\s+Exception\s*:"),
    ("mutable_default", "warn", r"def\s+\w+\([^)]*=\s*(\[\]|\{\})"),
)
KOTLIN_ISSUES = (
    ("!!_operator", "warn", r"\w\s*!!"),
    ("println_debug", "info", r"\bprintln\("),
    ("unsafe_cast", "warn", r"\bas\s+\w"),
)
GO_ISSUES = (
    ("nil_check_missing", "warn", r"\.([A-Z]\w*)\("),
    ("err_ignored", "danger", r"_\s*=\s*\w+\.\w+\("),
    ("fmt_print_debug", "info", r"fmt\.Print(ln|f)?\("),
    ("panic_call", "danger", r"\bpanic\("),
    ("unsafe_import", "warn", r'"unsafe"'),
)
JAVA_ISSUES = (
    ("print_stack_trace", "warn", r"\.printStackTrace\("),
    ("system_out_print", "info", r"System\.out\.print(ln)?\("),
    ("empty_catch", "warn", r"catch\s*\([^)]+\)\s*\{[\s;]*\}"),
    ("raw_type", "warn", r"\b(List|Map|Set|Collection|Iterator|Comparable)\s*[^<\w]"),
    ("magic_suppress", "info", r"@SuppressWarnings"),
)
C_ISSUES = (
    ("printf_debug", "info", r"\bprintf\(|\bfprintf\("),
    ("unsafe_malloc", "danger", r"=\s*malloc\s*\("),
    ("unsafe_free", "warn", r"free\s*\([^)]+\);"),
    ("goto_statement", "warn", r"\bgoto\s+\w+"),
    ("char_buffer", "warn", r"char\s+\w+\s*\[\d+\]"),
    ("void_star", "warn", r"void\s*\*"),
    ("define_macro", "info", r"#define\s+\w+"),
)
LANGUAGE_ISSUES = {
    "rust": RUST_ISSUES, "typescript": TYPESCRIPT_ISSUES, "javascript": TYPESCRIPT_ISSUES, "python": PYTHON_ISSUES, "kotlin": KOTLIN_ISSUES,
    "go": GO_ISSUES, "java": JAVA_ISSUES, "c": C_ISSUES, "cpp": C_ISSUES,
}


def issues(df: DataFrame, key: str, text: str, language: str | None = None, rules=COMMON_ISSUES, by_language=LANGUAGE_ISSUES) -> DataFrame:
    """key, rule, severity, occurrences of the rules for all languages and for each row's language. The
    few rules are literals; a rule of another language is not tried."""

    def hit(name: str, severity: str, pattern: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.regexp_count(F.col(text), F.lit(pattern)).alias("occurrences"))

    found = F.array(*[hit(*r) for r in rules])
    if language:
        own = F.array().cast("array<struct<rule:string,severity:string,occurrences:int>>")
        for name, mine in by_language.items():
            own = F.when(F.col(language) == name, F.array(*[hit(*r) for r in mine])).otherwise(own)
        found = F.concat(found, own)
    return df.select(key, F.explode(F.filter(found, lambda r: r["occurrences"] > 0)).alias("r")).select(key, "r.*")


def keyword_search(df: DataFrame, query: str, key: str, text: str, k: int, score: float = 0.5) -> DataFrame:
    """Rows with any of the query's first five words longer than two letters."""
    words = [w for w in query.split() if len(w) > 2][:5]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(F.col(text)), F.lit(w.lower()))
    return df.where(hit).select(key, F.lit(score).alias("score")).distinct().orderBy(key).limit(k)


def budgeted(df: DataFrame, text: str, order: list, chars: int) -> DataFrame:
    """The leading rows, in order, whose texts fit `chars` together, with truncated: whether rows were cut.

    Only rows of which the total before is below the budget are ranked: at most `chars` rows."""
    from pyspark.sql import Window

    short = df.where(F.length(text) > 0).orderBy(*order).limit(chars)
    total = F.sum(F.length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = short.withColumn("_total", total).withColumn("truncated", F.max("_total").over(Window.partitionBy()) > chars)
    return marked.where(F.col("_total") <= chars).drop("_total")


def extract(df: DataFrame, key: str, text: str, kinds: dict[str, str]) -> DataFrame:
    """key, kind, name: distinct first groups of each kind's pattern (tables, routes, config keys, imports)."""
    every = F.array(*[F.struct(F.lit(kind).alias("kind"), F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1))).alias("names")) for kind, p in kinds.items()])
    return df.select(key, F.explode(every).alias("x")).select(key, "x.kind", F.explode("x.names").alias("name"))


# Patterns of table names, HTTP marks and configuration keys in source text.
TABLE_NAMES = (r"(?i)\bFROM\s+(\w+)", r"(?i)\bUPDATE\s+(\w+)", r"(?i)\bINSERT\s+INTO\s+(\w+)", r"(?i)\bDELETE\s+FROM\s+(\w+)")
API_NAMES = ("route", "handler", "endpoint")
HTTP_MARK, ROUTE_MARK = r"(?i)#\[(?:get|post|put|delete|patch|head|options)\s*\(", r"(?i)@\w+\.(?:route|get|post|put|delete|patch)\s*\("
CONFIG_KEYS = (r"""env::var\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""config\.get\s*\(\s*['"]([^'"]+)['"]\s*\)""")


def cross_layer(df: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """key, layer (db, api or config), item: tables that a text names, why it is an API (its name, an HTTP
    attribute, a route decorator), configuration keys that it reads; each once."""
    groups = lambda patterns: F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in patterns])))
    named = F.lit(False)
    for word in API_NAMES if name else ():
        named = named | F.contains(F.lower(F.col(name)), F.lit(word))
    marks = ((named, "function_name_keyword"), (F.col(text).rlike(HTTP_MARK), "http_method_annotation"), (F.col(text).rlike(ROUTE_MARK), "route_decorator"))
    api = F.array_compact(F.array(*[F.when(hit, reason) for hit, reason in marks]))
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), items.alias("items")) for n, items in (("db", groups(TABLE_NAMES)), ("api", api), ("config", groups(CONFIG_KEYS)))])
    return df.where(F.col(text).isNotNull()).select(key, F.explode(layers).alias("x")).select(key, "x.layer", F.explode("x.items").alias("item"))


# Import statements by language.
IMPORTS = {
    "python": (r"(?m)^\s*import\s+([\w\.]+)", r"(?m)^\s*from\s+([\w\.]+)\s+import"),
    "rust": (r"(?m)^\s*use\s+([\w:]+)",),
    "go": (r'(?m)^\s*import\s+"([^"]+)"', r'(?m)^\s*"([^"]+)"'),
    "typescript": (r"""import\s+.*?from\s+['"]([^'"]+)['"]""", r"""require\(['"]([^'"]+)['"]\)"""),
}


def imports(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, path: what each text imports, in the patterns of its language; each path once."""
    found = F.array().cast("array<string>")
    for name, patterns in IMPORTS.items():
        every = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in patterns]))
        found = F.when(F.col(language) == name, every).otherwise(found)
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("path"))


# Rules that guard changes, as (rule, category, severity, pattern).
GUARDS = (
    ("GR-builtin-db-1", "db_safety", "warn", r"(?i)\bALTER\s+TABLE\b"),
    ("GR-builtin-db-2", "db_safety", "block", r"(?i)\bDROP\s+(?:TABLE|COLUMN)\b"),
    ("GR-builtin-api-1", "api_compat", "block", r"(?i)#\s*BREAKING\s+CHANGE"),
    ("GR-builtin-api-2", "api_compat", "block", r"(?i)//\s*REMOVED\s+PARAM"),
    ("GR-builtin-api-3", "api_compat", "block", r"(?i)//\s*REMOVED\s+FIELD"),
)
VARCHAR_SHRINK = r"(?i)VARCHAR\s*\(\s*(\d+)\s*\)\s*(?:→|->)\s*VARCHAR\s*\(\s*(\d+)\s*\)"
# What a function should have; (rule, severity, pattern).
READINESS = (
    ("GR-builtin-inc-1", "warn", r"\b(?:try|catch|unwrap|expect)\b|\?|Result"),
    ("GR-builtin-inc-2", "info", r"\blog::|tracing::|println!|print!|eprintln!|warn!|info!|error!|debug!"),
)
WRITES = (r"(?i)\b(?:INSERT|UPDATE|DELETE|CREATE|DROP)\b", r"\.(?:write|save|push|insert|update|delete)\s*\(")
SAFETY = r"(?i)\b(?:rollback|transaction|begin|undo|abort|commit)\b"
SHORTEST_BODY = 10


def match_lines(text: Column, pattern: str) -> Column:
    """struct(match, line) of every match.

    A text's line breaks and a mark for each match, in order, are cut at the breaks: a piece's marks are the matches
    of its line. One pass, however many matches there are."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    breaks = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\n]+", "")
    order = F.array_join(F.zip_with(between, matches, lambda b, m: F.concat(breaks(b), F.when(m.isNotNull(), F.lit("*")).otherwise(F.lit("")), breaks(m))), "")
    lines = F.flatten(F.transform(F.split(order, "\n", -1), lambda marks, i: F.array_repeat(i + 1, F.length(marks))))
    return F.zip_with(matches, lines, lambda m, n: F.struct(m.alias("match"), n.alias("line")))


def guard(df: DataFrame, key: str, text: str, rules=GUARDS) -> DataFrame:
    """key, rule, category, severity, line of every match of the rules and of every VARCHAR that gets
    shorter. rules: the built-in ones, or a caller's own."""
    def marked(matches: Column, name: str, category: str, severity: str) -> Column:
        return F.transform(matches, lambda m: F.struct(F.lit(name).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), m["line"].alias("line")))

    found = [marked(match_lines(F.col(text), p), *rule) for *rule, p in rules]
    if rules is GUARDS:
        size = lambda m, i: F.regexp_extract(m["match"], VARCHAR_SHRINK, i).cast("long")
        shrunk = F.filter(match_lines(F.col(text), VARCHAR_SHRINK), lambda m: size(m, 2) < size(m, 1))
        found.append(marked(shrunk, "GR-builtin-db-3", "db_safety", "block"))
    hit = F.lit(False)  # most texts are never cut
    for *_, p in (*rules, *[("", "", "", VARCHAR_SHRINK)] * (rules is GUARDS)):
        hit = hit | F.col(text).rlike(p)
    return df.where(hit).select(key, F.explode(F.flatten(F.array(*found))).alias("x")).select(key, "x.*")


def readiness(blocks: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, rule, severity of blocks (functions, or whole files without any) that handle no errors, log
    nothing, or write without a transaction; very short ones are left out."""
    text = F.col(body)
    writes = text.rlike(WRITES[0]) | text.rlike(WRITES[1])
    checks = [(n, s, ~text.rlike(p)) for n, s, p in READINESS] + [("GR-builtin-inc-3", "warn", writes & ~text.rlike(SAFETY))]
    missing = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, bad in checks]))
    long = F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) >= SHORTEST_BODY
    return blocks.where(long).select(*keys, F.explode(missing).alias("x")).select(*keys, "x.*")


def blocks_of(content: str) -> list[tuple[str, str, int, int]]:
    """Name, body, first and last line of functions: of those with braces up to the brace that closes, of
    Python's up to the next definition; the whole text as '<file>' if there are none."""
    out = []
    for m in re.finditer(r"\b(?:fn|func|function)\s+(\w+)", content):
        start = content.find("{", m.end())
        depth = 0
        for brace in re.finditer(r"[{}]", content[start:]) if start >= 0 else ():
            depth += 1 if brace[0] == "{" else -1
            if not depth:
                end = start + brace.end()
                out.append((m[1], content[start + 1 : end - 1], content.count("\n", 0, m.start()) + 1, content.count("\n", 0, end) + 1))
                break
    for m in re.finditer(r"\bdef\s+(\w+)\s*\([^:]*:[^\n]*\n", content):
        after = re.compile(r"^\s*(?:def|class)\s", re.M).search(content, m.end())
        end = after.start() if after else len(content)
        out.append((m[1], content[m.end() : end], content.count("\n", 0, m.start()) + 1, content.count("\n", 0, end) + 1))
    return out or [("<file>", content, 1, content.count("\n") + 1)]


def function_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, body, start_line, end_line of the functions of each text."""
    from pyspark.sql.types import StructType

    from ..ship import ship_package

    ship_package(df.sparkSession)
    schema = StructType([df.schema[key], *StructType.fromDDL("name string, body string, start_line int, end_line int").fields])

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, *b) for k, content in zip(frame[key], frame[text], strict=True) for b in blocks_of(content or "")]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema)


def shrinks(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, was, now where a VARCHAR's length gets smaller."""
    size = lambda c: F.regexp_extract(F.col(c), r"(?i)varchar\s*\(\s*(\d+)", 1).try_cast("int")
    return df.select(key, size(old).alias("was"), size(new).alias("now")).where("now < was")


def decide(found: DataFrame, key: str) -> DataFrame:
    """key, decision: block before warn before pass."""
    rank = F.max(F.when(F.col("severity") == "block", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    return found.groupBy(key).agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("block")), rank + 1).alias("decision"))
