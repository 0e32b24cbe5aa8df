"""Adaptive time partitions: a table's files follow its rows' moments, none above a number of rows.

Each task counts its moments in a trie of years, months, days and hours; tries are merged in a tree.
Nodes above the limit are split into all their members; a walk, depth first, joins neighbours within
the limit to leaves. Rows descend the folded trie, which is broadcast. Files hold a leaf's rows in
order, `limit` of them at most, and only files whose rows have changed are written anew.
"""

from __future__ import annotations

import calendar
import hashlib
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, require

NULL_LEAF = "null"
HOUR = 3_600_000_000
#: Levels that tries are merged in before the driver merges what is left.
DEPTH = 3

# A trie: years to months to days to hours to counts, nested dictionaries; null moments are under None.
Trie = dict


def hour_counts(batches: Iterator[pa.Array]) -> dict[int | None, int]:
    found: dict[int | None, int] = {}
    for moments in batches:
        if moments.null_count:
            found[None] = found.get(None, 0) + moments.null_count
        hours, counts = np.unique(micros(moments.drop_null()) // HOUR, return_counts=True)
        for h, n in zip(hours.tolist(), counts.tolist(), strict=True):
            found[h] = found.get(h, 0) + n
    return found


def micros(moments: pa.Array) -> np.ndarray:
    return moments.cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64)


def members(times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Year, month, day and hour of datetimes."""
    years, months, days = (times.astype(f"datetime64[{u}]") for u in "YMD")
    parts = (years.astype(np.int64) + 1970, (months - years.astype(months.dtype)).astype(np.int64) + 1, (days - months.astype(days.dtype)).astype(np.int64) + 1)
    return *parts, (times.astype("datetime64[h]") - days.astype("datetime64[h]")).astype(np.int64)


def trie_of(counts: dict[int | None, int]) -> Trie:
    trie: Trie = {}
    hours = sorted(h for h in counts if h is not None)
    for h, *path, hour in zip(hours, *(x.tolist() for x in members(np.array(hours, "datetime64[h]"))), strict=True):
        node = trie
        for key in path:
            node = node.setdefault(key, {})
        node[hour] = counts[h]
    if None in counts:
        trie[None] = counts[None]
    return trie


def merge(a: Trie, b: Trie) -> Trie:
    """The counts of both; associative. a is changed."""
    for key, own in b.items():
        if key not in a:
            a[key] = own
        elif isinstance(own, dict):
            merge(a[key], own)
        else:
            a[key] += own
    return a


def count_moments(moments: DataFrame) -> Trie:
    """The trie of the first column. It has a number for each hour that occurs, which the calendar bounds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(hour_counts(b.column(0) for b in batches))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trie)], pa.binary())], names=["trie"])

    tries = moments.mapInArrow(build, "trie binary").rdd.map(lambda row: pickle.loads(row[0]))
    return tries.treeReduce(merge, DEPTH) if tries.getNumPartitions() else {}


@dataclass(frozen=True)
class Leaf:
    name: str
    rows: int


@dataclass
class Layout:
    """Leaves in time order, the one of null moments last, and the folded trie: a node's members are
    child[start[node] + member - first[node]], a leaf's number or -1 - another node's."""

    leaves: list[Leaf]
    child: np.ndarray
    start: np.ndarray
    first: np.ndarray

    def descend(self, moments: pa.Array) -> np.ndarray:
        """The number of each moment's leaf."""
        known = ~np.asarray(moments.is_null())
        out = np.full(len(moments), len(self.leaves) - 1, np.int32)
        path = members(micros(moments.drop_null()).astype("datetime64[us]"))
        node, found = np.zeros(len(path[0]), np.int64), np.zeros(len(path[0]), np.int64)
        open_rows = np.arange(len(path[0]))
        for level in path:
            found[open_rows] = self.child[self.start[node] + level[open_rows] - self.first[node]]
            open_rows = open_rows[found[open_rows] < 0]
            node = -1 - found[open_rows]
        out[known] = found
        return out


def fold(trie: Trie, limit: int) -> Layout:
    """The leaves of a trie: siblings within the limit, even empty ones, join the run of the sibling
    before as long as it stays within; nodes above are split, hours above are leaves."""
    leaves: list[Leaf] = []
    nodes: list[list[int]] = []
    firsts: list[int] = []

    def total(node: Trie | int) -> int:
        return node if isinstance(node, int) else sum(map(total, node.values()))

    def walk(node: Trie, path: tuple[int, ...], span: range) -> int:
        number = len(nodes)
        nodes.append([0] * len(span))
        firsts.append(span.start)
        own = nodes[number]
        name = lambda a, b: "/".join(f"{p:04d}" if k == 0 else f"{p:02d}" for k, p in enumerate(path)) + "/" * bool(path) + "-".join(f"{m:02d}" if path else f"{m:04d}" for m in (a, b))
        run: list[int] = []  # of members
        rows = 0

        def close() -> None:
            for m in run:
                own[m - span.start] = len(leaves)
            if rows:
                leaves.append(Leaf(name(run[0], run[-1]), rows))

        for m in span:
            below = node.get(m, 0)
            n = total(below)
            if n <= limit and run and rows + n <= limit:
                run.append(m)
                rows += n
                continue
            close()
            run, rows = ([m], n) if n <= limit else ([], 0)
            if n > limit and len(path) == 3:
                own[m - span.start] = len(leaves)
                leaves.append(Leaf(name(m, m), n))
            elif n > limit:
                deeper = (*path, m)
                spans = {1: range(1, 13), 2: range(1, calendar.monthrange(2000 + deeper[0] % 400, m)[1] + 1) if len(deeper) == 2 else None, 3: range(24)}
                own[m - span.start] = -1 - walk(below, deeper, spans[len(deeper)])
        close()
        return number

    years = [y for y in trie if y is not None]
    if years:
        walk(trie, (), range(min(years), max(years) + 1))
    leaves.append(Leaf(NULL_LEAF, trie.get(None, 0)))
    starts = np.cumsum([0, *map(len, nodes)])[:-1] if nodes else np.zeros(0)
    return Layout(leaves, np.array([c for x in nodes for c in x], np.int64), starts.astype(np.int64), np.array(firsts, np.int64))


class Files:
    """A folder of a table's partitions. moment: a TIMESTAMP_NTZ of a row's columns; order: the columns
    that rows of a moment are ordered by (nulls first; rows that are equal in them by a hash of all).

    A file is a folder below a leaf's, so columns of any name come through; names of the helpers avoid
    theirs. Types with maps are hashed as JSON. The number of leaves and of their nodes is bounded by the
    number of rows over the limit and the calendar, not by the rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, moment: Column, order: Sequence[str], limit: int):
        self.spark, self.folder, self.schema, self.moment, self.order, self.limit = spark, folder, schema, moment, order, limit
        taken = {c.lower() for c in schema.names}

        def free(name: str) -> str:
            while name in taken:
                name += "_"
            return name

        self.leaf, self.part, self.no, self.at, self.hash, self.range, self.before, self.rank = map(free, ("leaf", "part", "leaf_no", "moment_of_row", "hash_of_row", "range_no", "rows_before", "rank_in_leaf"))
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)

    def _hashes(self) -> list[Column]:
        """Two hashes of a row, of which nulls are part."""
        cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`") for f in self.schema]
        nulls = [c.isNull() for c in cols]
        return [F.xxhash64(*cols, *nulls), F.xxhash64(*nulls, *reversed(cols), F.lit(1))]

    def _sums(self) -> list[Column]:
        """An aggregate that tells files with other rows apart: 128 bits of hashes, in sums that do not overflow below 2^31 rows."""
        halves = [x for h in self._hashes() for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        return [F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(halves)]]

    def _sorted_by(self) -> list[str]:
        return [self.at, *(f"`{c}`" for c in self.order), self.hash]

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """rows with their leaf (its name without slashes) and part."""
        layout = fold(count_moments(rows.select(self.moment.alias("moment"))), self.limit)
        shared = self.spark.sparkContext.broadcast(layout)

        @F.arrow_udf("int")
        def leaf_no(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for moments in batches:
                yield pa.array(shared.value.descend(moments), pa.int32())

        names = F.from_json(F.lit(f"[{', '.join(f'"{slot(x.name)}"' for x in layout.leaves)}]"), "array<string>")
        rows = rows.withColumns({self.at: self.moment, self.hash: self._hashes()[0]})
        rows = rows.withColumn(self.no, leaf_no(self.at))
        named = lambda x: x.withColumn(self.leaf, F.coalesce(F.get(names, F.col(self.no)), F.lit("")))
        large = [k for k, x in enumerate(layout.leaves) if x.rows > self.limit]
        if not large:
            return named(rows).withColumn(self.part, F.lit(1))
        small = rows.where(~F.col(self.no).isin(*large)).withColumn(self.part, F.lit(1))
        return named(small.unionByName(self._ranked(rows.where(F.col(self.no).isin(*large)))))

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """Parts of leaves above the limit. Ranges of rows are sorted each by itself; a row's rank is the
        rows of its leaf in the ranges before and its number in its own."""
        keys = [self.no, *self._sorted_by()]
        # Equal rows too can go to several ranges: the row's place in the scan is the last key.
        dealt = rows.withColumn(self.rank, F.monotonically_increasing_id()).repartitionByRange(*[F.col(k) for k in (*keys, self.rank)])
        ranges = materialise(dealt.withColumn(self.range, F.spark_partition_id()), "time-ranges")
        own = ranges.groupBy(self.no, self.range).agg(F.count("*").alias(self.before))
        earlier = Window.partitionBy(self.no).orderBy(self.range).rowsBetween(Window.unboundedPreceding, -1)
        before = own.withColumn(self.before, F.coalesce(F.sum(self.before).over(earlier), F.lit(0)))
        nth = F.row_number().over(Window.partitionBy(self.no, self.range).orderBy(*self._sorted_by(), self.rank))
        placed = ranges.join(before, [self.no, self.range]).withColumn(self.rank, nth)
        part = F.floor((F.col(self.before) + F.col(self.rank) - 1) / self.limit).cast("int") + 1
        return placed.withColumn(self.part, part).drop(self.range, self.before, self.rank)

    def read(self) -> DataFrame:
        """The folder's rows, with their leaf (without slashes) and part."""
        fields = [T.StructField(f.name, f.dataType) for f in self.schema] + [T.StructField(self.leaf, T.StringType()), T.StructField(self.part, T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self.folder)

    def rewrite(self, rows: DataFrame) -> set[str]:
        """Makes the folder hold rows, and tells the files that stay: of those that were there, the ones
        whose leaf, part and rows are wanted again. New files are complete before old ones go; what a
        crash between the two leaves, the next call puts right. Empty rows: an empty folder."""
        sums = self._sums()
        there = self.read().groupBy(self.leaf, self.part, F.col("_metadata.file_path").alias("path")).agg(*sums).collect()
        numbered = self._numbered(rows)
        stays: dict[tuple, str] = {}
        if there:
            wanted = {tuple(r) for r in numbered.groupBy(self.leaf, self.part).agg(*sums).collect()}
            for leaf, part, path, *own in sorted(there):
                if (leaf, part, *own) in wanted:
                    stays.setdefault((leaf, part), path)
            changed = [f"{leaf}/{part}" for leaf, part, *_ in wanted if (leaf, part) not in stays]
            numbered = numbered.where(F.concat_ws("/", self.leaf, self.part).isin(*changed)) if changed else None
        if numbered is not None:
            order = [self.leaf, self.part, *self._sorted_by()]
            dealt = numbered.repartition(self.leaf, self.part).sortWithinPartitions(*order)
            dealt.select(*[f"`{c}`" for c in self.schema.names], self.leaf, self.part).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(self.leaf, self.part).parquet(self.folder)
        self._delete([x[2] for x in there if x[2] not in set(stays.values())])
        return set(stays.values())

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            file = self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(path))
            self._fs.delete(file, False)
            for folder in (file.getParent(), file.getParent().getParent()):
                if not len(self._fs.listStatus(folder)):
                    self._fs.delete(folder, False)

    def digests(self, ident: str, new: Column) -> DataFrame:
        """Of every file: leaf, part, path, ids_sha256 (of the decimal idents in file order, comma-joined,
        null as nothing), n_rows and n_new (rows where new holds). A file's idents are hashed as a stream."""
        rows = self.read().select(F.col(self.leaf).alias("leaf"), F.col(self.part).cast("long").alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")).alias("ident"), F.coalesce(new, F.lit(False)).alias("new"))
        dealt = rows.repartition("path").sortWithinPartitions("path", "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, digest, n, new_rows = None, None, 0, 0
            done: list[tuple] = []
            for batch in batches:
                path = np.asarray(batch.column(2).dictionary_encode().indices)
                begins = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                for a, b in zip(begins[:-1], begins[1:], strict=True) if len(path) else ():
                    at = tuple(batch.column(k)[a].as_py() for k in range(3))
                    if at != key:
                        if key:
                            done.append((*key, digest.hexdigest(), n, new_rows))
                        key, digest, n, new_rows = at, hashlib.sha256(), 0, 0
                    part = batch.slice(a, b - a)
                    digest.update((("," if n else "") + ",".join(part.column(4).to_pylist())).encode())
                    n, new_rows = n + len(part.column(4)), new_rows + (part.column(5).true_count or 0)
            if key:
                done.append((*key, digest.hexdigest(), n, new_rows))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*done, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["leaf", "part", "path", "ids_sha256", "n_rows", "n_new"])

        found = dealt.mapInArrow(run, "leaf string, part long, path string, ids_sha256 string, n_rows long, n_new long")
        return found.withColumn("leaf", F.replace("leaf", F.lit("."), F.lit("/")))


def slot(leaf: str) -> str:
    """A leaf's name in a path."""
    return leaf.replace("/", ".")


def time_files(rows: DataFrame, folder: str, moment: Column, order: Sequence[str], limit: int) -> Files:
    """A folder for the rows' table, as yet empty or of an earlier call. moment: a TIMESTAMP_NTZ; null
    moments, in any number, are a leaf of their own. Repeated rows are rows like others."""
    require(rows, *order)
    if limit < 1:
        raise ValueError("a file holds at least one row")
    return Files(rows.sparkSession, folder.rstrip("/"), rows.schema, moment, order, limit)
