"""A staging log on shared storage, a watched folder as a stream, and back-pressure.

The log is append-only: entries and their state changes are Parquet files of numbered generations, so a
writer that dies leaves whole files or none, and the state of an entry is its change of the highest number."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The states of an entry, and what each may become.
NEXT = {"pending": ("applying",), "applying": ("applied", "failed", "pending"), "failed": ("pending",), "applied": ()}
ENTRY = "change long, lsn long, status string, changed_at timestamp, path string, kind string, content_hash string"


class StagingLog:
    """Entries (path, kind, content_hash) with log sequence numbers, below a folder all executors share.

    A writer claims the next number by creating a file that must not exist, waits for the writers before it,
    and only then reads the state that it changes, so writers never work on the same state. One that has
    not ended `patience` seconds later counts as dead: its number is closed, what it still writes is refused."""

    def __init__(self, spark: SparkSession, folder: str, patience: float = 60):
        self.spark, self.folder, self.patience = spark, folder.rstrip("/"), patience
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(n for x in self._fs.listStatus(self._path(self.folder)) if (n := x.getPath().getName()).startswith(start))

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def _generations(self) -> list[str]:
        return [n for n in self._names("log-") if self._exists(f"{n}/_SUCCESS")]

    def _create(self, name: str) -> bool:
        """Whether this call has created the file."""
        from py4j.protocol import Py4JJavaError

        try:
            self._fs.create(self._path(f"{self.folder}/{name}"), False).close()
            return True
        except Py4JJavaError:
            if self._exists(name):
                return False
            raise

    def _claim(self) -> int:
        """The next number, once all before it are written or closed."""
        claimed = self._names("claim-")
        n = int(claimed[-1][6:]) + 1 if claimed else 0
        while not self._create(f"claim-{n:09d}"):
            n += 1
        began = time.monotonic()
        while open_ones := [k for k in range(n) if self._exists(f"claim-{k:09d}") and not self._exists(f"log-{k:09d}/_SUCCESS") and not self._exists(f"log-{k:09d}/_closed")]:
            if time.monotonic() - began >= self.patience:
                for k in open_ones:
                    self._create(f"log-{k:09d}/_closed")
            else:
                time.sleep(0.2)
        return n

    def changes(self) -> DataFrame:
        """All entries and changes; of a compacted log, what compaction kept and what came after."""
        names = self._generations()
        base = [n for n in names if self._exists(f"{n}/_base")]
        live = names[names.index(base[-1]) :] if base else names
        if not live:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.folder}/{n}" for n in live])

    def _write(self, n: int, rows: DataFrame, base: bool = False) -> None:
        """Rows as the generation n: written aside, then renamed, which a closed number refuses."""
        aside, there = f"aside-{n:09d}-{uuid.uuid4().hex}", f"log-{n:09d}"
        rows.withColumn("change", F.lit(n).cast("long")).select(*[x.split()[0] for x in ENTRY.split(", ")]).write.parquet(f"{self.folder}/{aside}")
        if base:
            self._create(f"{aside}/_base")
        done = not self._exists(there) and self._fs.rename(self._path(f"{self.folder}/{aside}"), self._path(f"{self.folder}/{there}"))
        if not done or not self._exists(f"{there}/_SUCCESS"):
            raise RuntimeError(f"number {n} of the log was closed while it was written; write again")

    def state(self) -> DataFrame:
        """One row an entry: its last change."""
        last = F.max(F.struct("change", "changed_at", "status")).alias("m")
        what = self.changes().groupBy("lsn").agg(last, F.first("path", True).alias("path"), F.first("kind", True).alias("kind"), F.first("content_hash", True).alias("content_hash"))
        return what.select("lsn", "m.status", "m.changed_at", "path", "kind", "content_hash")

    def append(self, events: DataFrame, now: str) -> None:
        """Adds events as pending entries, numbered in the order of path behind the last number. Numbers need one
        order of a batch; a batch is what back-pressure lets through."""
        from pyspark.sql import Window

        n = self._claim()
        last = self.changes().agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("last")).first()["last"]
        rows = events.select("path", "kind", "content_hash").withColumn("lsn", F.row_number().over(Window.orderBy("path", "kind", "content_hash")) + last)
        self._write(n, rows.withColumns({"status": F.lit("pending"), "changed_at": F.lit(now).cast("timestamp")}))

    def transition(self, to: str, now: str, where: str = "true") -> None:
        """Entries that fit `where` and may become `to` do; others stay as they are."""
        n = self._claim()
        allowed = [s for s, after in NEXT.items() if to in after]
        rows = self.state().where(where).where(F.col("status").isin(allowed))
        self._write(n, rows.withColumns({"status": F.lit(to), "changed_at": F.lit(now).cast("timestamp")}))

    def recover(self, now: str) -> None:
        """After a crash: what was being applied is pending again."""
        self.transition("pending", now, "status = 'applying'")

    def replay(self, apply: Callable[[DataFrame], None], now: str) -> None:
        """Applies pending entries in one batch, the last entry of each path; marks them applied, or failed if
        apply raises. apply has to stand being called again with the same entries."""
        self.transition("applying", now, "status = 'pending'")
        rows = self.state().where("status = 'applying'")
        try:
            apply(rows.groupBy("path").agg(F.max(F.struct("lsn", "kind", "content_hash")).alias("m")).select("path", "m.lsn", "m.kind", "m.content_hash"))
        except Exception:
            self.transition("failed", now, "status = 'applying'")
            raise
        self.transition("applied", now, "status = 'applying'")

    def compact(self) -> None:
        """A new base without applied entries; older files are no longer read. The last number is kept."""
        n = self._claim()
        state = self.state()
        last = F.broadcast(state.agg(F.max("lsn").alias("last")))  # one row
        self._write(n, state.crossJoin(last).where("status != 'applied' or lsn = last").drop("last"), base=True)


def watch(spark: SparkSession, folder: str, extensions: tuple[str, ...], max_files: int = 1000) -> DataFrame:
    """path, content_hash, changed_at, size of files with these extensions as they appear or change below a
    folder: a stream. max_files a micro-batch is its back-pressure: the rest waits, nothing is dropped."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
    rows = files.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return rows.select("path", F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("changed_at"), F.col("length").alias("size"))


def shed(batch: DataFrame, held_entries: int, held_bytes: int, size: str = "size", most_entries: int = 10_000, most_bytes: int = 256 << 20) -> tuple[DataFrame, bool]:
    """The batch and False if it fits what is held within the limits; else no rows and True: the queue is full
    and the caller has to reconcile the folder as a whole instead."""
    batch = batch.persist()  # counted and returned: computed once
    new = batch.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    full = held_entries + new["n"] > most_entries or held_bytes + new["bytes"] > most_bytes
    if full:
        batch.unpersist()
    return (batch.limit(0), True) if full else (batch, False)
