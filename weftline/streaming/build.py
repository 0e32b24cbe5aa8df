"""Derived tables of files, kept up to date from the files that have changed.

A generation holds the facts of the files that changed in it and the edges that had to be resolved
again: those of these files, and those of any file that name a symbol which came, went or changed. Facts
are written by the last segment of their names (`bucket`), so a refresh reads the buckets of the changed
names and no other. Generations are written aside and renamed; a reader sees whole ones only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve_calls
from ..plans.iterate import small_enough, write_round
from ..sources.code import canonical_source, parse_tree, source_files
from .staging import StagingLog

#: Columns of the stored tables; each has gen, and all but files and imports have bucket.
TABLES = {
    "files": "path string, hash string, removed boolean",
    "symbols": "path string, id long, qualified string, name string, kind string, start_line int, end_line int, short string",
    "calls": "path string, scope string, module string, name string, line int, short string",
    "imports": "path string, alias string, target string",
    "edges": "file string, module string, name string, callee_id long, callee_file string, method string, is_cross boolean, short string",
}
BUCKETED = ("symbols", "calls", "edges")


class Facts(NamedTuple):
    """symbols: path, id, qualified, name, kind, start_line, end_line. calls: path, scope, module, name, line.
    imports: path, alias, target. Ids must depend on the file's content alone."""

    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(F.replace(name, F.lit("::"), F.lit(".")), r"\."), -1)


class DerivedTables:
    """files, symbols, calls, imports and edges below a folder that all executors share; one writer."""

    def __init__(self, spark: SparkSession, folder: str, externals: DataFrame | None = None, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.externals = externals if externals is not None else spark.createDataFrame([], "id long, qualified string, name string, package string")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Reading

    def generations(self) -> list[int]:
        """Those that count: the last whole rewrite and what came after."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        found = sorted(int(n[4:]) for n in names if n.startswith("gen-"))
        whole = [g for g in found if self._fs.exists(self._path(f"{self.folder}/gen-{g:09d}/_whole"))]
        return found[found.index(whole[-1]) :] if whole else found

    def _stored(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all generations, of some buckets if given: other buckets' files are not read."""
        schema = f"{TABLES[table]}, gen long" + ", bucket int" * (table in BUCKETED)
        folders = [f"{self.folder}/gen-{g:09d}/{table}" for g in self.generations()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = None
        for folder in folders:  # each has its own partition column
            one = self.spark.read.schema(schema).parquet(folder)
            rows = one if rows is None else rows.unionByName(one)
        return rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows

    def _live(self) -> DataFrame:
        """path, hash and gen of the files that are there: gen wrote their facts."""
        last = self._stored("files").groupBy("path").agg(F.max(F.struct("gen", "hash", "removed")).alias("m"))
        return last.where("not m.removed").select("path", "m.hash", "m.gen")

    def _current(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        return self._stored(table, buckets).join(self._live().select("path", "gen"), ["path", "gen"], "left_semi")

    def files(self) -> DataFrame:
        return self._live().select("path", "hash")

    def table(self, name: str) -> DataFrame:
        """symbols, calls, imports or edges as they are now."""
        columns = [c.split()[0] for c in TABLES[name].split(", ") if not c.startswith("short ")]
        return (self._edges() if name == "edges" else self._current(name)).select(*columns)

    def _edges(self, buckets: list[int] | None = None) -> DataFrame:
        """The last answer for each call that is still made."""
        key = ["file", "module", "name"]
        made = self._current("calls", buckets).select(F.col("path").alias("file"), "module", "name").distinct()
        answer = F.max(F.struct("gen", "callee_id", "callee_file", "method", "is_cross", "short")).alias("m")
        last = self._stored("edges", buckets).groupBy(*key).agg(answer)
        # Both are grouped by the key, so they meet where they are; a copy of all calls would pass through the driver.
        return last.join(made.hint("merge"), key, "left_semi").select(*key, "m.callee_id", "m.callee_file", "m.method", "m.is_cross", "m.short")

    # Writing

    def apply(self, changed: DataFrame, removed: DataFrame, facts: Callable[[DataFrame], Facts]) -> int | None:
        """Takes over changed files (path, hash) and removals (path). facts gets the changed paths that have
        another hash than is stored and returns what they hold; equal ones cost nothing, so a call that
        is repeated after a crash changes nothing. The generation written; None if there was nothing to do."""
        live = self._live()
        fresh = write_round(changed.select("path", "hash").join(live.select("path", "hash"), ["path", "hash"], "left_anti"), "changed")
        gone = write_round(removed.select("path").join(live.select("path"), "path", "left_semi").join(fresh, "path", "left_anti").distinct(), "removed")
        if fresh.isEmpty() and gone.isEmpty():
            return None
        found = facts(fresh.select("path"))
        short = last_segment(F.col("name"))
        keep = lambda df, table: df.withColumn("short", short).select(*[c.split()[0] for c in TABLES[table].split(", ")])
        symbols = write_round(keep(found.symbols, "symbols").withColumn("short", last_segment(F.col("qualified"))), "symbols")
        calls = write_round(keep(found.calls.withColumn("module", F.coalesce("module", F.lit(""))), "calls"), "calls")
        imports = write_round(found.imports.select("path", "alias", "target"), "imports")
        touched = fresh.select("path").unionByName(gone)

        # Names of which a definition came, went or changed.
        what = ["path", "id", "qualified", "name", "short"]
        before = self._current("symbols").join(touched, "path", "left_semi").select(*what)
        both = before.withColumn("d", F.lit(-1)).unionByName(symbols.select(*what).withColumn("d", F.lit(1)))
        names = both.groupBy(*what).agg(F.sum("d").alias("d")).where("d != 0").select("short").distinct()
        names = write_round(names, "names")
        # Calls to resolve: those of changed files, and those of others by such a name.
        key = ["path", "module", "name", "short"]
        others = self._current("calls", self._buckets_of(names)).join(touched, "path", "left_anti").join(small_enough(names, 100), "short", "left_semi")
        asked = write_round(calls.select(*key).unionByName(others.select(*key)).distinct(), "asked")
        wanted = asked.select("short").distinct()
        known = self._current("symbols", self._buckets_of(wanted)).join(touched, "path", "left_anti").select(*what).unionByName(symbols.select(*what))
        known = known.join(small_enough(wanted, 100), "short", "left_semi").select("id", "qualified", "name", F.col("path").alias("file"))
        paths = asked.select("path").distinct()
        imported = self._current("imports").join(touched, "path", "left_anti").select("path", "alias", "target").unionByName(imports).join(paths, "path", "left_semi")
        answers = resolve_calls(asked.withColumnRenamed("path", "file"), known, imported.select(F.col("path").alias("file"), "alias", F.col("target").alias("path")), self.externals)
        files = fresh.withColumn("removed", F.lit(False)).unionByName(gone.select("path", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("removed")))
        return self._publish({"files": files, "symbols": symbols, "calls": calls, "imports": imports, "edges": answers.withColumn("short", short)})

    def _bucket(self, short: Column) -> Column:
        return F.pmod(F.xxhash64(short), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, names: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return [r["b"] for r in names.select(self._bucket(F.col("short")).alias("b")).distinct().collect()]

    def _publish(self, tables: dict[str, DataFrame], whole: bool = False) -> int:
        done = self.generations()
        gen = done[-1] + 1 if done else 1
        aside, there = f"{self.folder}/aside-{uuid.uuid4().hex}", f"{self.folder}/gen-{gen:09d}"
        for name, rows in tables.items():
            rows = rows.withColumn("gen", F.lit(gen).cast("long"))
            if name in BUCKETED:  # ranges of buckets and paths: a large bucket goes to several tasks
                by = "file" if name == "edges" else "path"
                rows = rows.withColumn("bucket", self._bucket(F.col("short")))
                rows.repartitionByRange("bucket", by).sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(f"{aside}/{name}")
            else:
                rows.write.parquet(f"{aside}/{name}")
        if whole:
            self._fs.create(self._path(f"{aside}/_whole"), False).close()
        if self._fs.exists(self._path(there)) or not self._fs.rename(self._path(aside), self._path(there)):
            raise RuntimeError(f"generation {gen} is there already: another writer")
        return gen

    def compact(self) -> int:
        """All tables as they are now in one generation; earlier ones are no longer read."""
        live = write_round(self._live(), "live")
        tables = {n: self._current(n).select(*[c.split()[0] for c in TABLES[n].split(", ")]) for n in ("symbols", "calls", "imports")}
        return self._publish({"files": live.select("path", "hash", F.lit(False).alias("removed")), **tables, "edges": self._edges()}, whole=True)


#: Up to so many changed files are opened by name; beyond, the tree is read once.
OPENED = 1000


class SourceBuild:
    """Symbols, calls, imports and edges of a source tree. Changes go through a staging log: after a crash at
    any step `refresh` takes up what was pending, and what was applied already changes nothing."""

    def __init__(self, spark: SparkSession, tree: str, folder: str, buckets: int = 64, patience: float = 60):
        self.spark, self.tree, self.folder = spark, tree, folder.rstrip("/")
        self.tables = DerivedTables(spark, f"{self.folder}/tables", buckets=buckets)
        self.log = StagingLog(spark, f"{self.folder}/log", patience)

    def listing(self) -> DataFrame:
        """path, stamp (time and length) of the source files: no file is opened."""
        files = source_files(self.spark, self.tree)
        return files.select("path", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp"))

    def _seen(self) -> DataFrame:
        """path, stamp of the last change of each file that is in the log or applied."""
        last = self.log.state().groupBy("path").agg(F.max(F.struct("lsn", "kind", "content_hash")).alias("m"))
        return last.where("m.kind != 'removed'").select("path", F.col("m.content_hash").alias("stamp"))

    def changes(self) -> DataFrame:
        """path, kind, content_hash (the stamp): what differs from the log."""
        both = self.listing().join(self._seen().withColumnRenamed("stamp", "old"), "path", "full").where("not (stamp <=> old)")
        kind = F.when(F.col("stamp").isNull(), "removed").when(F.col("old").isNull(), "created").otherwise("modified")
        return both.select("path", kind.alias("kind"), F.col("stamp").alias("content_hash"))

    def refresh(self, now: str) -> None:
        """Brings the tables to the state of the tree."""
        self.log.recover(now)
        self.log.transition("pending", now, "status = 'failed'")
        found = write_round(self.changes(), "events")
        if not found.isEmpty():
            self.log.append(found, now)
        self.log.replay(self._apply, now)

    def _apply(self, batch: DataFrame) -> None:
        batch = write_round(batch.select("path", "kind"), "batch")
        changed = batch.where("kind != 'removed'").select("path")
        paths = [r["path"] for r in changed.limit(OPENED + 1).collect()]
        if not paths and batch.isEmpty():
            return
        files = source_files(self.spark, paths if paths and len(paths) <= OPENED else self.tree)
        contents = write_round(canonical_source(files).join(changed, "path", "left_semi"), "contents")

        def facts(fresh: DataFrame) -> Facts:
            rows = write_round(parse_tree(contents.join(fresh, "path", "left_semi")), "facts")
            return tree_facts(rows)

        gone = batch.select("path").join(contents.select("path"), "path", "left_anti")  # removed, or no longer there
        self.tables.apply(contents.select("path", "hash"), gone, facts)


def tree_facts(rows: DataFrame) -> Facts:
    """What parse_tree has found, as facts: a symbol's qualified name is its module's (the path's last segment
    without extension) and its own; its id is a hash of path, name and line."""
    module = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    ident = F.abs(F.xxhash64("path", "scope", "start_line", "kind") % F.lit(1 << 62))
    symbols = rows.where("fact = 'symbol'").select("path", ident.alias("id"), F.concat_ws(".", module, "scope").alias("qualified"), "name", "kind", "start_line", "end_line")
    called = F.col("name")
    calls = rows.where("fact = 'call'").select("path", "scope", F.regexp_extract(called, r"^(.*)\.[^.]*$", 1).alias("module"), F.element_at(F.split(called, r"\."), -1).alias("name"), F.col("start_line").alias("line"))
    imports = rows.where("fact = 'import'").select("path", F.element_at(F.split("name", r"[./]"), -1).alias("alias"), F.regexp_replace("name", r"^\.+", "").alias("target"))
    return Facts(symbols, calls, imports)
