"""Loops over DataFrames: each round's state is written to shared storage, so that lineage stays
short and a lost executor costs a round's tasks at most."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_round(df: DataFrame, name: str = "round", file_rows: int = 0) -> DataFrame:
    """df, written and read back. file_rows: rows of a file at most (0: any number); files are read in parallel, however
    few bytes they have."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table up to this size is worth a copy on every executor.
SMALL_BYTES = 32 << 20


def small_enough(df: DataFrame, row_bytes: int, limit: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows times row_bytes are within the limit, else as it is."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def merge_or_copy(df: DataFrame, row_bytes: int, limit: int = SMALL_BYTES) -> DataFrame:
    """small_enough, and where df is not small a hint against a copy: planned by the size of its files, which
    hold equal values once, a table of millions of rows would be collected on the driver."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


class Budget:
    """Limits of a traversal: depth, nodes, results, nodes of a level (frontier) and seconds from the first
    level on; `partial` tells whether one was reached."""

    def __init__(self, depth: int = 5, nodes: int | None = 1000, results: int | None = 100, frontier: int | None = 500, seconds: float | None = None):
        self.depth, self.nodes, self.results, self.frontier, self.seconds = depth, nodes, results, frontier, seconds
        self.partial, self.began = False, None

    def goes_on(self, level: int, nodes: int, frontier: int = 0) -> bool:
        now = time.monotonic()
        self.began = now if self.began is None else self.began
        over = lambda value, limit: limit is not None and value > limit
        if level > self.depth or over(nodes, self.nodes) or over(frontier, self.frontier) or over(now - self.began, self.seconds):
            self.partial = True
            return False
        return True

    def cut(self, df: DataFrame, *order) -> DataFrame:
        """The first `results` rows in a total order, with a column partial."""
        if self.results is not None:
            ranked = df.orderBy(*order).limit(self.results + 1)
            more = ranked.count() > self.results
            self.partial = self.partial or more
            df = df.orderBy(*order).limit(self.results)
        return df.withColumn("partial", F.lit(self.partial))
