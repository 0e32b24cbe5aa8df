"""A watched folder: created, modified, removed and renamed files, from successive listings.

A scan compares the listing with that of the scan before; only new and changed files are opened, for
their hash. Events and listing are written aside and renamed together, so a scan counts whole or not
at all. A stream over the events pairs removals with arrivals of the same content."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import write_round

EVENT = "kind string, path string, content_hash string, at timestamp, nth int"
LISTED = "path string, stamp string, content_hash string"
#: Up to so many files are opened by name; beyond, the folder is read once.
OPENED = 1000


class FolderWatch:
    """Scans of the files with some extensions below `folder`; events and listings go below `out`. One scan at a time."""

    def __init__(self, spark: SparkSession, folder: str, out: str, extensions: tuple[str, ...]):
        self.spark, self.folder, self.out = spark, folder, out.rstrip("/")
        self.glob = "*.{" + ",".join(extensions) + "}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self, paths: str | list[str]) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.glob).load(paths)

    def scans(self) -> list[int]:
        if not self._fs.exists(self._path(self.out)):
            return []
        return sorted(int(n[5:]) for x in self._fs.listStatus(self._path(self.out)) if (n := x.getPath().getName()).startswith("scan-"))

    def scan(self, now: str) -> int:
        """Writes the events since the last scan, at the time `now`; the scan's number. A file with a new time and
        the same content is no event."""
        done = self.scans()
        before = self.spark.read.schema(LISTED).parquet(f"{self.out}/scan-{done[-1]:09d}/listing") if done else self.spark.createDataFrame([], LISTED)
        now_there = write_round(self._files(self.folder).select("path", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp")), "listing")
        both = now_there.join(before.select("path", F.col("stamp").alias("old"), F.col("content_hash").alias("old_hash")), "path", "left")
        changed = both.where("not (stamp <=> old)").select("path")
        paths = [r["path"] for r in changed.limit(OPENED + 1).collect()]
        opened = self._files(paths if len(paths) <= OPENED else self.folder) if paths else None
        if opened is None:
            hashes = self.spark.createDataFrame([], "path string, new_hash string")
        else:
            hashes = write_round(opened.join(changed, "path", "left_semi").select("path", F.sha2("content", 256).alias("new_hash")), "hashes")
        # A file that went between listing and reading is left to the next scan.
        joined = both.join(hashes, "path", "left").where("stamp <=> old or new_hash is not null")
        listing = write_round(joined.select("path", "stamp", F.coalesce("new_hash", "old_hash").alias("content_hash"), "old_hash"), "listed")
        fresh = listing.where("not (content_hash <=> old_hash)").select(F.when(F.col("old_hash").isNull(), "created").otherwise("modified").alias("kind"), "path", "content_hash")
        gone = before.join(now_there, "path", "left_anti").select(F.lit("removed").alias("kind"), "path", "content_hash")
        same = Window.partitionBy("kind", "content_hash").orderBy("path")  # the copies of one content
        events = fresh.unionByName(gone).withColumns({"at": F.lit(now).cast("timestamp"), "nth": F.row_number().over(same)})
        n = done[-1] + 1 if done else 1
        aside = f"{self.out}/aside-{uuid.uuid4().hex}"
        events.select(*[c.split()[0] for c in EVENT.split(", ")]).write.parquet(f"{aside}/events")
        listing.select(*[c.split()[0] for c in LISTED.split(", ")]).write.parquet(f"{aside}/listing")
        there = self._path(f"{self.out}/scan-{n:09d}")
        if self._fs.exists(there) or not self._fs.rename(self._path(aside), there):
            raise RuntimeError(f"scan {n} is there already: another watcher")
        return n

    def events(self, stream: bool = True) -> DataFrame:
        """EVENT rows of all scans; as a stream, those of scans to come too."""
        reader = self.spark.readStream if stream else self.spark.read
        return reader.schema(EVENT).parquet(f"{self.out}/scan-*/events")


def with_renames(events: DataFrame, within: str = "2 seconds") -> DataFrame:
    """kind, path, from_path, content_hash, at: a removal and an arrival of the same content within that time are one
    event, renamed; the k-th copy that goes is the k-th that comes. On a stream an event that could still be
    paired waits for the watermark, which is set here; state is what waits."""
    late = events.withWatermark("at", within)
    side = lambda kind, p: late.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{p}_{c}") for c in ("path", "content_hash", "at", "nth")])
    gone, come = side("removed", "gone"), side("created", "come")
    span = F.expr(f"come_at >= gone_at - interval {within} and come_at <= gone_at + interval {within}")
    both = gone.join(come, (F.col("gone_content_hash") == F.col("come_content_hash")) & (F.col("gone_nth") == F.col("come_nth")) & span, "full_outer")
    kind = F.when(F.col("come_path").isNull(), "removed").when(F.col("gone_path").isNull(), "created").otherwise("renamed")
    paired = both.select(
        kind.alias("kind"), F.coalesce("come_path", "gone_path").alias("path"), F.when(F.col("come_path").isNotNull(), F.col("gone_path")).alias("from_path"),
        F.coalesce("come_content_hash", "gone_content_hash").alias("content_hash"), F.greatest("come_at", "gone_at").alias("at"),
    )
    rest = late.where("kind = 'modified'").select("kind", "path", F.lit(None).cast("string").alias("from_path"), "content_hash", "at")
    return paired.unionByName(rest)


def as_hashes(events: DataFrame) -> DataFrame:
    """path, at, content_hash for hash_diff: null where a file went, for a renamed one of both its paths."""
    entry = lambda path, hash_: F.struct(F.col(path).alias("path"), hash_.alias("content_hash"))
    gone, there = F.lit(None).cast("string"), F.col("content_hash")
    moved = F.array(entry("from_path", gone), entry("path", there))
    rows = F.when(F.col("kind") == "renamed", moved).otherwise(F.array(entry("path", F.when(F.col("kind") != "removed", there))))
    return events.select("at", F.explode(rows).alias("r")).select("r.path", "at", "r.content_hash")
