"""Writers: upsert, insert or ignore, replace by partition, and text formats."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.histograms import BOUNDS, buckets


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _swap(df: DataFrame, path: str) -> None:
    """Writes beside the target, then renames; the old table is kept aside until the new one is there, so
    neither a failed write nor a crash between the steps loses it."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    jvm = spark.sparkContext._jvm
    new, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{beside}-old")
    kept = fs.exists(target)
    if kept and not fs.rename(target, old):
        raise OSError(f"cannot rename {path}")
    if not fs.rename(new, target):
        if kept:
            fs.rename(old, target)
        raise OSError(f"cannot rename {beside} to {path}")
    if kept:
        fs.delete(old, True)


def upsert(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rows of df replace those with the same key; of several in df the last by `order` wins."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order or keys]))
    fresh = df.withColumn("_n", rank).where("_n = 1").drop("_n")
    if _exists(df.sparkSession, path):
        old = df.sparkSession.read.schema(df.schema).parquet(path)
        fresh = old.join(fresh.select(*keys), keys, "left_anti").select(*df.columns).unionByName(fresh)
    _swap(fresh, path)


def insert_ignore(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key is not there yet."""
    fresh = df.dropDuplicates(keys)
    if _exists(df.sparkSession, path):
        fresh = fresh.join(df.sparkSession.read.schema(df.schema).parquet(path).select(*keys), keys, "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that df has rows of."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def mermaid(edges: DataFrame, a: str = "src_module", b: str = "dst_module", n: str = "calls") -> DataFrame:
    """value: the lines of a Mermaid graph, in order; write.text takes it."""
    name = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\W", "_")
    lines = edges.select(F.lit(1).alias("_o"), F.concat(F.lit("  "), name(a), F.lit(" -->|"), F.col(n).cast("string"), F.lit("| "), name(b)).alias("value"))
    head = edges.sparkSession.createDataFrame([(0, "graph LR")], "_o int, value string")
    return head.unionByName(lines).orderBy("_o", "value").select("value")


def dot(edges: DataFrame, a: str = "src_module", b: str = "dst_module", n: str = "calls") -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit("'")), F.lit('"'))
    lines = edges.select(F.lit(1).alias("_o"), F.concat(F.lit("  "), quoted(a), F.lit(" -> "), quoted(b), F.lit(" [label="), F.col(n).cast("string"), F.lit("];")).alias("value"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph g {"), (2, "}")], "_o int, value string")
    return ends.unionByName(lines).orderBy("_o", "value").select("value")


def sarif_results(findings: DataFrame) -> DataFrame:
    """value: one SARIF 2.1.0 result a finding (rule, severity, message, file, start_line, end_line)."""
    level = F.when(F.upper("severity").isin("ERROR", "BLOCK"), "error").when(F.upper("severity").isin("WARNING", "WARN"), "warning").otherwise("note")
    place = F.struct(
        F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation")
    )
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select(F.to_json(result).alias("value"))


def sarif(findings: DataFrame, tool: str, most: int = 100_000) -> DataFrame:
    """value: one SARIF 2.1.0 document. It is one string, so it raises beyond `most` findings."""
    results = sarif_results(findings)
    if results.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} findings: write sarif_results as JSON lines")
    head = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":' + f'"{tool}"' + '}},"results":['
    body = F.array_join(F.array_sort(F.collect_list("value")), ",")
    return results.agg(F.concat(F.lit(head), body, F.lit("]}]}")).alias("value"))


def _labels(labels: list[str]) -> Column:
    """Pairs of names and escaped values: backslashes, quotes and line feeds; null is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    escape = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels])


def prometheus_histogram(histograms: DataFrame, name: str, labels: list[str], bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """value: the text exposition of histograms (see operators.histograms): buckets, sum and count of each."""
    own = histograms.withColumn("_own", _labels(labels))
    comma = F.when(F.col("_own") != "", F.concat("_own", F.lit(","))).otherwise("")
    end = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    rows = buckets(own, "_own", bounds=bounds).select("_own", F.lit(1).alias("_o"), "le", F.concat(F.lit(f"{name}_bucket{{"), comma, F.lit('le="'), end, F.lit('"} '), F.col("n").cast("string")).alias("value"))
    braced = F.when(F.col("_own") != "", F.concat(F.lit("{"), "_own", F.lit("} "))).otherwise(" ")
    for o, (suffix, column) in enumerate((("sum", "total"), ("count", "n")), 2):
        rows = rows.unionByName(own.select("_own", F.lit(o).alias("_o"), F.lit(0.0).alias("le"), F.concat(F.lit(f"{name}_{suffix}"), braced, F.col(column).cast("string")).alias("value")))
    head = histograms.sparkSession.createDataFrame([("", 0, 0.0, f"# TYPE {name} histogram")], "_own string, _o int, le double, value string").withColumn("_first", F.lit(0))
    return head.unionByName(rows.withColumn("_first", F.lit(1))).orderBy("_first", "_own", "_o", "le").select("value")


def prometheus(samples: DataFrame, name: str, kind: str, labels: list[str], value: str) -> DataFrame:
    """value: the text exposition of one metric."""
    pairs = _labels(labels)
    lines = samples.select(F.lit(1).alias("_o"), F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("value"))
    head = samples.sparkSession.createDataFrame([(0, f"# TYPE {name} {kind}")], "_o int, value string")
    return head.unionByName(lines).orderBy("_o", "value").select("value")
