"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_package

#: A word is a run of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def hash_fraction(col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 30)) / F.lit(float(1 << 30))


def valid_text(text: Column) -> Column:
    """A text column for Python workers: bytes that are no UTF-8 become U+FFFD, null stays null."""
    return F.make_valid_utf8(text.cast("string"))


def hashable(df: DataFrame) -> list[Column]:
    """All columns of df as values to hash, and whether each is null; types with maps, which have no hash, as JSON."""
    cols = [F.to_json(F.struct(df[f.name])) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else df[f.name] for f in df.schema]
    return [*cols, *(df[f.name].isNull() for f in df.schema)]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = jvm_dir.get() if jvm_dir.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(shared)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


#: Files a core that a narrow table is written to at most.
FILES = 4


def materialise(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that it ran. narrow: some numbers a document or less; such a table
    is written to FILES files a core at most, not to as many as the shuffle has partitions."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_heaps(spark: SparkSession) -> None:
    """Has every executor collect its garbage. A heap that one operator has grown is given back to the
    system, where the Python workers of the next one need the memory. Nothing to do in local mode."""
    if not spark.sparkContext.master.startswith("local["):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: What a worker remembers from one task to the next, by name; each is bounded by bytes.
KEPT: dict = {}


def release_worker(keep: str | None = None) -> None:
    """Ends a task: gives back what it has freed, and what other operators' tasks have left in KEPT, so that
    a worker, which lives on for other operators, holds one cache at most."""
    for name in [x for x in KEPT if x != keep]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


#: Bytes of text that are worked on at once.
SLICE = 1 << 18


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each one begins (and the last one ends); null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def slices(at: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Rows (from, to) whose texts hold about `most` bytes together, at least one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (most or SLICE), "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def require(df: DataFrame, *columns: str) -> None:
    """Raises if a column is missing; sends the package to the executors, whose Python workers need it."""
    ship_package(df.sparkSession)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
