"""Micro-batches published as immutable generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_wins(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return batch.withColumn("_n", rank).where("_n = 1").drop("_n")


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Published generation numbers, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(x[4:]) for x in found if x.startswith("gen=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS"))]
    return sorted(done)


def publisher(folder: str, key: str, order: list[str], deleted: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the last generation and writes generation batch_id + 1.

    A generation counts once its _SUCCESS file is there; a batch that is run again writes the same
    generation again, so a failed or repeated batch changes nothing."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest_wins(batch, key, order)
        before = [g for g in generations(spark, folder) if g <= batch_id]
        if before:
            old = spark.read.schema(batch.schema).parquet(f"{folder}/gen={before[-1]}")
            fresh = old.join(fresh.select(key), key, "left_anti").select(*batch.columns).unionByName(fresh)
        if deleted:
            fresh = fresh.where(~F.col(deleted))
        fresh.write.mode("overwrite").parquet(f"{folder}/gen={batch_id + 1}")

    return publish


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/gen={generations(spark, folder)[-1]}")


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest generations; the numbers deleted."""
    jvm = spark.sparkContext._jvm
    old = generations(spark, folder)[:-keep]
    for g in old:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/gen={g}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return old
