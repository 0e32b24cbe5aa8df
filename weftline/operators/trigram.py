"""A stored trigram index: postings on shared storage, read by the buckets of a query's grams only.

A generation holds the postings and gram counts of the texts that were added in it, partitioned by a
hash of the gram and sorted by it, and the keys that came or went. The last generation of a key counts,
so a text that is added again replaces its former one. Generations are written aside and renamed.
A row of postings has a gram and its keys among some hundreds of texts, which a task has met together."""

from __future__ import annotations

import re
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..plans.iterate import merge_or_copy, write_round
from ..ship import ship_package

#: Postings of so many of a query's rarest grams are met; the text confirms the others.
MET = 3
#: Characters of the texts whose grams are sorted together.
SLICE = 1 << 20
#: Parts of a bucket, which go to tasks of their own where there are as many.
PARTS = 4


def query_grams(query: str) -> list[str]:
    """The trigrams of a query's words of three letters or more; its shorter words are confirmed only."""
    return sorted({t.lower()[i : i + 3] for t in re.findall(r"[A-Za-z0-9_]+", query) for i in range(len(t) - 2)})


def _grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct grams, where the texts (by number) of each begin, and these: each text once a gram, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(0x110000, bool)
    there[chars] = True
    letters = np.flatnonzero(there)
    codes, n = (np.cumsum(there) - 1)[chars], len(letters)
    begins = np.repeat(np.cumsum(sizes) - sizes, np.maximum(sizes - 2, 0))
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - 2, 0))
    at = begins + np.arange(len(begins)) - np.searchsorted(owner, owner)
    gram = (codes[at] * n + codes[at + 1]) * n + codes[at + 2]
    if n**3 * len(texts) >= 1 << 63:  # tens of thousands of letters: grams by their rank
        kinds, gram = np.unique(gram, return_inverse=True)
    else:
        kinds = None
    pairs = np.unique(gram * len(texts) + owner)
    gram, owner = np.divmod(pairs, max(len(texts), 1))
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    kind = gram[first] if kinds is None else kinds[gram[first]]
    parts = np.stack([letters[kind // n // n], letters[kind // n % n], letters[kind % n]], axis=1) if len(kind) else np.empty((0, 3))
    whole = parts.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)], np.append(first, len(owner)), owner


def gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n, keys: the n keys whose texts (key, text) hold a gram, slice by slice of the texts."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        begin = size = 0
        for i in range(len(batch) + 1):
            size += len(texts[i].as_py()) if i < len(batch) else 0
            if i > begin and (i == len(batch) or size > SLICE):
                grams, at, owner = _grams(texts.slice(begin, i - begin).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), keys.slice(begin, i - begin).take(pa.array(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(at)), lists], ["gram", "n", "keys"])
                begin, size = i, len(texts[i].as_py()) if i < len(batch) else 0


class TrigramIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Those that count: the last whole rewrite and what came after."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = sorted(n for x in self._fs.listStatus(self._path(self.folder)) if (n := x.getPath().getName()).startswith("gen-"))
        whole = [n for n in names if self._fs.exists(self._path(f"{self.folder}/{n}/_whole"))]
        return [int(n[4:]) for n in (names[names.index(whole[-1]) :] if whole else names)]

    def _stored(self, table: str) -> DataFrame:
        folders = [f"{self.folder}/gen-{g:09d}/{table}" for g in self.generations()]
        if not folders:
            raise ValueError("nothing has been added to the index")
        rows = self.spark.read.parquet(folders[0])
        for folder in folders[1:]:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(folder))
        return rows

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _publish(self, keys: DataFrame, postings: DataFrame | None, whole: bool = False) -> None:
        done = self.generations()
        gen = done[-1] + 1 if done else 1
        aside, there = f"{self.folder}/aside-{uuid.uuid4().hex}", f"{self.folder}/gen-{gen:09d}"
        keys.withColumn("gen", F.lit(gen)).write.parquet(f"{aside}/keys")
        if postings is None:
            postings = self._stored("postings").limit(0)
        rows = postings.select("gram", "n", "keys").withColumns({"gen": F.lit(gen), "bucket": self._bucket(F.col("gram"))})
        # A bucket goes to PARTS tasks by its grams, sorted, so that a file holds neighbours.
        tasks = min(self.buckets * PARTS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        part = F.pmod(F.col("bucket") * PARTS + F.pmod(F.hash("gram"), F.lit(PARTS)), F.lit(tasks))
        dealt = rows.repartitionById(tasks, part.cast("int")).sortWithinPartitions("bucket", "gram")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{aside}/postings")
        counts = self.spark.read.schema(rows.schema).parquet(f"{aside}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{aside}/counts")
        if whole:
            self._fs.create(self._path(f"{aside}/_whole"), False).close()
        if self._fs.exists(self._path(there)) or not self._fs.rename(self._path(aside), self._path(there)):
            raise RuntimeError(f"generation {gen} is there already: another writer")

    def add(self, texts: DataFrame, key: str, text: str) -> None:
        """Adds texts, or replaces those of keys that are there. Null texts are texts without grams."""
        rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
        ship_package(self.spark)
        lists = StructType([StructField("gram", StringType()), StructField("n", LongType()), StructField("keys", ArrayType(rows.schema["key"].dataType))])
        whole = F.make_valid_utf8(F.lower("text"))  # a query's grams are ASCII
        grams = rows.where(F.length("text") >= 3).select("key", whole.alias("text")).mapInArrow(gram_lists, lists)
        self._publish(rows.select("key").distinct().withColumn("removed", F.lit(False)), grams)

    def remove(self, keys: DataFrame, key: str) -> None:
        self._publish(keys.select(F.col(key).alias("key")).distinct().withColumn("removed", F.lit(True)), None)

    def live(self) -> DataFrame:
        """key, gen of the texts that are there: gen has their postings."""
        last = self._stored("keys").groupBy("key").agg(F.max(F.struct("gen", "removed")).alias("m"))
        return last.where("not m.removed").select("key", "m.gen")

    def postings(self, grams: list[str]) -> DataFrame:
        """gram, key, gen, bucket of some grams: their buckets are read, and of these the row groups that hold them."""
        return self._of("postings", grams).select("gram", F.explode("keys").alias("key"), "gen", "bucket")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        one = self.spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("gram")).select(self._bucket(F.col("gram")).alias("b"))
        buckets = sorted({r["b"] for r in one.collect()})  # as many as the query has grams
        return self._stored(table).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def candidates(self, query: str) -> DataFrame:
        """key of texts that hold the MET rarest grams of a query; all keys if it has none."""
        grams = query_grams(query)
        if not grams:
            return self.live().select("key")
        counts = {r["gram"]: r["n"] for r in self._of("counts", grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rare = sorted(grams, key=lambda x: (counts.get(x, 0), x))[:MET]
        held = self.postings(rare).groupBy("key", "gen").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rare))
        return held.join(self.live(), ["key", "gen"], "left_semi").select("key")

    def search(self, query: str, texts: DataFrame, key: str, text: str) -> DataFrame:
        """Rows of texts whose text holds every word of the query, in any case: candidates, then the text itself."""
        found = write_round(self.candidates(query).withColumnRenamed("key", key), "candidates")
        rows = texts.join(merge_or_copy(found, 100), key, "left_semi")  # few keys are copied, texts are not shuffled
        for word in re.findall(r"[A-Za-z0-9_]+", query):
            rows = rows.where(F.contains(F.lower(F.col(text)), F.lit(word.lower())))
        return rows

    def compact(self) -> None:
        """One generation of what is there; earlier ones are no longer read."""
        live = write_round(self.live(), "live")
        each = self._stored("postings").select("gram", F.explode("keys").alias("key"), "gen").join(live, ["key", "gen"], "left_semi")
        # Lists of a part of the keys each.
        keys = each.groupBy("gram", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
        postings = keys.select("gram", F.size("keys").cast("long").alias("n"), "keys")
        self._publish(live.select("key", F.lit(False).alias("removed")), postings, whole=True)
