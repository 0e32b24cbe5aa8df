"""Source trees, build files, reports and logs as DataFrames."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship_package

# File extensions by language.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift",
    "scala": "scala", "lua": "lua", "sh": "shell", "vue": "vue",
}
#: Definitions of languages other than Python: a keyword and a name, or a type, a name and a list.
DEFINITION = re.compile(r"^\s*(?:(?:pub|public|private|protected|static|final|async|export|default|override|open|internal|abstract|suspend|inline|virtual|unsafe)\s+)*(?:(class|struct|interface|trait|enum|object|module|impl|protocol)\s+(\w+)|(?:func|fn|def|fun|function|sub)\s+(?:\([^)]*\)\s*)?([\w.:]+)\s*[(<]|[\w<>\[\],*&:]+\s+\*?(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{)")
CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
IMPORT = re.compile(r"""^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:static\s+)?["']?([\w./@-]+)|#include\s*[<"]([^>"]+)|use\s+([\w:]+)|require\s*\(?["']([^"']+))""")
# Words before '(' that call nothing.
NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "def", "sizeof", "elif", "match", "with", "and", "or", "not", "in", "is", "lambda", "super", "assert", "print", "len", "range", "str", "int", "list", "dict", "set"}


def canonical_text(text: Column) -> Column:
    """Without byte order mark, with line feeds only and no white space at line ends."""
    out = F.regexp_replace(text, "^﻿", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    return F.regexp_replace(out, r"[ \t]+(\n|$)", "$1")


def source_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, modificationTime, length, content and language of the source files below folders or at paths;
    what is not selected of them is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    language = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), lambda k, _: k == F.lower(F.substring_index("path", ".", -1)))), F.lit(0))
    return files.withColumn("language", language).where("language is not null")


def canonical_source(files: DataFrame) -> DataFrame:
    """path, language, content, hash of source files, canonical. Bytes that are no UTF-8 are replaced, so no
    file is lost."""
    utf16 = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(utf16, F.decode("content", "UTF-16")).otherwise(F.col("content").cast("string"))
    rows = files.select("path", "language", canonical_text(F.make_valid_utf8(text)).alias("content"))
    return rows.withColumn("hash", F.sha2("content", 256))


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, content, hash of the source files below a folder, canonical."""
    return canonical_source(source_files(spark, folder))


def _python(content: str) -> tuple[list, list, list]:
    tree = ast.parse(content)
    symbols, calls, imports = [], [], []

    def walk(node, scope: str):
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}.{child.name}" if scope else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if scope else "function"
                symbols.append((child.name, inner, kind, child.lineno, child.end_lineno))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(("." * child.level + (child.module or ""), child.lineno))
            elif isinstance(child, ast.Call):
                name = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", name) and name not in NO_CALL:
                    calls.append((scope, name, child.lineno))
            walk(child, inner)

    walk(tree, "")
    return symbols, calls, imports


def parse(content: str, language: str) -> tuple[list, list, list]:
    """Symbols (name, qualified, kind, start, end), calls (scope, name, line), imports (name, line)."""
    if language == "python":
        try:
            return _python(content)
        except (SyntaxError, ValueError, RecursionError):
            pass
    symbols, calls, imports = [], [], []
    lines = content.split("\n")
    scope, owner = "", ""
    for i, line in enumerate(lines, 1):
        if found := IMPORT.match(line):
            imports.append((next(x for x in found.groups() if x), i))
            continue
        if found := DEFINITION.match(line):
            name = next((x for x in found.groups()[1:] if x), None)
            if name and name not in NO_CALL:
                if found[1]:
                    owner, kind, scope = name, "class", name
                else:
                    kind, scope = ("method", f"{owner}.{name}") if owner and line[:1].isspace() else ("function", name)
                if symbols:
                    symbols[-1] = (*symbols[-1][:4], max(symbols[-1][3], i - 1))
                symbols.append((name, scope, kind, i, len(lines)))
                line = line[found.end() :]
        calls += [(scope, m[1], i) for m in CALL.finditer(line) if m[1] not in NO_CALL]
    return symbols, calls, imports


PARSED = "path string, language string, hash string, fact string, scope string, name string, kind string, start_line int, end_line int"


def parse_tree(files: DataFrame) -> DataFrame:
    """One row for each fact (symbol, call or import) of the files; equal contents are parsed once."""
    ship_package(files.sparkSession)
    once = files.dropDuplicates(["hash", "language"]).select("hash", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("hash", pa.string()), ("language", pa.string()), ("fact", pa.string()), ("scope", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                symbols, calls, imports = parse(x["content"] or "", x["language"])
                rows += [(x["hash"], x["language"], "symbol", q, n, k, a, b) for n, q, k, a, b in symbols]
                rows += [(x["hash"], x["language"], "call", s, n, "call", line, line) for s, n, line in calls]
                rows += [(x["hash"], x["language"], "import", "", n, "import", line, line) for n, line in imports]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    facts = once.mapInArrow(run, "hash string, language string, fact string, scope string, name string, kind string, start_line int, end_line int")
    return files.select("path", "hash", "language").join(facts, ["hash", "language"]).select(*[x.split()[0] for x in PARSED.split(", ")])


def _numbered(spark: SparkSession, path: str, joined: str | None = None) -> DataFrame:
    """path, n, line of whole text files: a report's lines have an order. joined: what is a space, such as
    line ends that do not end a line."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    if joined:
        files = files.withColumn("value", F.regexp_replace("value", joined, " "))
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """file, line, hits of an LCOV report. A record, up to its end_of_record, is one row of the scan, so a
    large report is read by many tasks."""
    rows = spark.read.option("lineSep", "end_of_record").text(path)
    lines = F.split("value", "\r?\n")
    file = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("SF:"))), F.lit(0))
    hits = rows.select(F.substr(file, F.lit(4)).alias("file"), F.explode(F.filter(lines, lambda x: F.startswith(x, F.lit("DA:")))).alias("l")).where("file != ''")
    parts = F.split(F.substr("l", F.lit(4)), ",")
    return hits.select("file", F.get(parts, F.lit(0)).try_cast("int").alias("line"), F.get(parts, F.lit(1)).try_cast("long").alias("hits")).where("line is not null")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """file, line, hits of a report, LCOV or Cobertura by the file's name."""
    return cobertura(spark, path) if path.lower().rstrip("*").endswith((".xml", ".xml.gz")) else lcov(spark, path)


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """file, line, hits of a Cobertura report."""
    line = "array<struct<_number:int,_hits:long>>"
    rows = spark.read.format("xml").option("rowTag", "class").schema(f"_filename string, lines struct<line:{line}>").load(path)
    return rows.select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l")).select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """test, suite, status, duration_ms, message of a JUnit report."""
    problem = "struct<_message:string,_type:string,_VALUE:string>"
    schema = f"_name string, _classname string, _time double, failure {problem}, error {problem}, skipped {problem}"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(F.col("_name").alias("test"), F.col("_classname").alias("suite"), status.alias("status"), F.round(F.col("_time") * 1000, 3).alias("duration_ms"), F.coalesce("failure._message", "error._message").alias("message"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, ts, file, added, deleted of `git log --numstat --format=commit:%H%x09%an%x09%at`. A
    commit is one row of the scan, so a long log is read by many tasks."""
    rows = spark.read.option("lineSep", "\ncommit:").text(path).select(F.regexp_replace("value", "^commit:", "").alias("value"))
    lines = F.split("value", "\r?\n")
    head = F.split(F.get(lines, F.lit(0)), "\t")
    stats = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^[0-9-]+\t[0-9-]+\t")))
    files = rows.select(F.get(head, F.lit(0)).alias("commit"), F.get(head, F.lit(1)).alias("author"), F.get(head, F.lit(2)).try_cast("double").alias("ts"), F.explode(stats).alias("s"))
    stat = F.split("s", "\t", 3)
    count = lambda i: F.coalesce(F.get(stat, F.lit(i)).try_cast("long"), F.lit(0))
    return files.select("commit", "author", "ts", F.get(stat, F.lit(2)).alias("file"), count(0).alias("added"), count(1).alias("deleted"))


def git_blame(spark: SparkSession, path: str) -> DataFrame:
    """file, author, ts of each line of `git blame --line-porcelain` outputs; for lookups.blame_owners. The
    line's own text, behind a tab, ends a row of the scan and is left out."""
    rows = spark.read.option("lineSep", "\n\t").text(path)
    head = F.regexp_extract("value", r"(?s)((?:^|\n)[0-9a-f]{40} .*)$", 1)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name} (.*)$", 1)
    return rows.where(head != "").select(field("filename").alias("file"), field("author").alias("author"), F.timestamp_seconds(field("author-time").try_cast("long")).alias("ts"))


def symbol_changes(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """commit, file, symbol of hunks (commit, file, from_line, to_line) that overlap symbols (file, id, start_line,
    end_line)."""
    from ..operators.joins import overlaps

    return overlaps(hunks, symbols, ["file"]).select("commit", "file", F.col("id").alias("symbol")).distinct()


def unified_diff(spark: SparkSession, path: str) -> DataFrame:
    """file, from_line, to_line, added, deleted of each hunk, by the new file's lines."""
    rows = _numbered(spark, path)
    file_line = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]+)", 1)
    hunk = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    size = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    order = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumns({"file": F.last(F.when(file_line != "", file_line), ignorenulls=True).over(order), "_h": F.when(hunk != "", hunk.try_cast("int")), "_s": F.when(size != "", size.try_cast("int"))})
    rows = rows.withColumn("_k", F.count("_h").over(order)).where("_k > 0")
    out = rows.groupBy("path", "file", "_k").agg(
        F.max("_h").alias("from_line"), F.max(F.when(F.col("_h").isNotNull(), F.coalesce("_s", F.lit(1)))).alias("_n"),
        F.count_if(F.col("line").rlike(r"^\+(?!\+\+ )")).alias("added"), F.count_if(F.col("line").rlike("^-(?!-- )")).alias("deleted"),
    )
    return out.where("from_line is not null").select("file", "from_line", (F.col("from_line") + F.greatest("_n", F.lit(1)) - 1).alias("to_line"), "added", "deleted")


def codeowners(spark: SparkSession, path: str) -> DataFrame:
    """idx, pattern (a regular expression), owner; for joins.last_rule. All rules, in order."""
    from ..operators.joins import glob_to_regex

    ship_package(spark)
    rows = _numbered(spark, path).where(r"trim(line) != '' and trim(line) not like '#%'")
    found = rows.select(F.col("n").alias("idx"), F.split(F.trim("line"), r"\s+").alias("p"))

    def run(frames):
        for frame in frames:
            frame["pattern"] = [glob_to_regex(p[0]) if p[0] != "*" else "" for p in frame["p"]]
            frame["owner"] = [" ".join(p[1:]) for p in frame["p"]]
            yield frame[["idx", "pattern", "owner"]]

    return found.mapInPandas(run, "idx int, pattern string, owner string")


def requirement_lines(rows: DataFrame, line: str) -> DataFrame:
    """rows plus name and requirement of lines such as 'name >= 1.2 ; marker'; comments and options go."""
    at = F.col(line)
    name = F.lower(F.regexp_extract(at, r"^\s*([A-Za-z0-9_.-]+)", 1))
    wanted = F.trim(F.regexp_extract(at, r"^\s*[A-Za-z0-9_.-]+\s*((?:[<>=!~^]=?=?\s*[^;#,\s]+)?)", 1))
    return rows.where(~at.rlike(r"^\s*(#|-|$)")).withColumns({"name": name, "requirement": wanted})


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """path, name, requirement of requirements files, package.json, Cargo.toml and go.mod below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    named = lambda end: files.where(F.col("path").endswith(end))
    plain = files.where(F.col("path").rlike(r"requirements[^/]*\.txt$")).select("path", F.explode(F.split("value", "\r?\n")).alias("line"))
    out = requirement_lines(plain, "line").select("path", "name", "requirement")
    package = F.from_json("value", "dependencies map<string,string>, devDependencies map<string,string>")
    for kind in ("dependencies", "devDependencies"):
        out = out.unionByName(named("package.json").select("path", F.explode(package[kind]).alias("name", "requirement")))
    block = F.regexp_extract("value", r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1)
    cargo = named("Cargo.toml").select("path", F.explode(F.split(block, "\r?\n")).alias("line")).where(r"line rlike '^[A-Za-z0-9_-]+\\s*='")
    version = F.regexp_extract("line", r"\"([^\"]+)\"", 1)
    out = out.unionByName(cargo.select("path", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("name"), version.alias("requirement")))
    go = named("go.mod").select("path", F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+ v\S+)"), F.lit(1))).alias("line"))
    return out.unionByName(go.select("path", F.split_part("line", F.lit(" "), F.lit(1)).alias("name"), F.split_part("line", F.lit(" "), F.lit(2)).alias("requirement")))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """defines, includes, flags of a compilation database, unioned over its entries."""
    rows = spark.read.option("multiLine", "true").schema("directory string, command string, arguments array<string>, file string").json(path)
    words = rows.select(F.coalesce("arguments", F.split("command", r"\s+")).alias("w"))
    after = lambda i: F.get("w", i + 1)

    def values(*prefixes: str) -> Column:
        """Of '-Ivalue' and '-I value'."""
        found = F.array().cast("array<string>")
        for prefix in prefixes:
            mark = F.lit(prefix)
            glued = F.filter("w", lambda x: F.startswith(x, mark) & (x != mark))  # noqa: B023
            apart = F.transform("w", lambda x, i: F.when(x == mark, after(i)))  # noqa: B023
            found = F.concat(found, F.transform(glued, lambda x: F.substr(x, F.length(mark) + 1)), F.array_compact(apart))  # noqa: B023
        return found

    taken = ("-D", "-I", "-isystem", "-o")
    value = lambda i: (i > 0) & F.coalesce(F.get("w", i - 1).isin(*taken), F.lit(False))
    own = lambda x: F.startswith(x, F.lit("-D")) | F.startswith(x, F.lit("-I")) | F.startswith(x, F.lit("-isystem")) | x.isin("-c", "-o")
    flags = F.filter("w", lambda x, i: F.startswith(x, F.lit("-")) & ~own(x) & ~value(i))
    each = words.select(values("-D").alias("defines"), values("-I", "-isystem").alias("includes"), flags.alias("flags"))
    return each.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in each.columns])


def makefile(spark: SparkSession, path: str) -> DataFrame:
    """kind (variable or target), name, value; a line that ends in a backslash goes on in the next one."""
    rows = _numbered(spark, path, r"[ \t]*\\\r?\n[ \t]*")
    variable, target = r"^(\w+)\s*[:+?]?=\s*(.*)$", r"^([\w./%-]+)\s*:(?!=)\s*(.*)$"
    kind = F.when(F.col("line").rlike(variable), "variable").when(F.col("line").rlike(target), "target")
    part = lambda i: F.when(F.col("kind") == "variable", F.regexp_extract("line", variable, i)).otherwise(F.regexp_extract("line", target, i))
    return rows.withColumn("kind", kind).where("kind is not null").select("kind", part(1).alias("name"), F.trim(part(2)).alias("value"))


def semgrep(spark: SparkSession, path: str) -> DataFrame:
    """rule, file, start_line, end_line, severity, message of a scanner's JSON results."""
    extra = "struct<severity:string,message:string,lines:string,fix:string>"
    schema = f"results array<struct<check_id:string,path:string,start:struct<line:int>,`end`:struct<line:int>,extra:{extra}>>"
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("results").alias("r"))
    return rows.select(F.col("r.check_id").alias("rule"), F.col("r.path").alias("file"), F.col("r.start.line").alias("start_line"), F.col("r.end.line").alias("end_line"), F.col("r.extra.severity").alias("severity"), F.col("r.extra.message").alias("message"))


def attributed(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """findings (file, start_line, ...) with symbol: the id of the narrowest of symbols (file, id, start_line, end_line)
    that holds their first line; null if none does."""
    from ..operators.joins import stab_narrowest

    held = stab_narrowest(findings.select("file", F.col("start_line").alias("line")).distinct(), symbols, ["file"])
    return findings.join(held.select("file", F.col("line").alias("start_line"), F.col("id").alias("symbol")), ["file", "start_line"], "left")
