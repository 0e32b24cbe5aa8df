"""The test tables in the roles of the model: entities, edges, versions, findings, coverage.

Each role has a DataFrame here and the same relation as SQL for a second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, line: the part of an order line and that of the next line of the order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = lines.select("l_orderkey", F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst", F.col("l_linenumber").alias("line"))


EDGES = """edges as (select a.l_partkey as src, b.l_partkey as dst, a.l_linenumber as line
    from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, module, kind, qualified, start_line, end_line of the parts."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("module"),
        F.col("p_type").alias("kind"),
        F.concat_ws("::", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("qualified"),
        F.col("p_partkey").alias("start_line"),
        (F.col("p_partkey") + F.col("p_size")).alias("end_line"),
    )


ENTITIES = """entities as (select p_partkey as id, p_name as name, p_brand as module, p_type as kind,
    p_brand || '::' || p_type || '::' || p_partkey::varchar as qualified, p_partkey as start_line, p_partkey + p_size as end_line from part)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, version, name, hash: turns of conversations as versions of an entity."""
    rows = read(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("entity"), F.col("turn").alias("version"), F.col("role").alias("name"), F.sha2("text", 256).alias("hash"), "text")


VERSIONS = "versions as (select conv_id as entity, turn as version, role as name, sha256(text) as hash, text from conversations)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, rule, severity, line, user_id, ts of error events."""
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    severity = F.when(F.col("value") >= 66, "ERROR").when(F.col("value") >= 33, "WARNING").otherwise("INFO")
    return rows.select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("rule"), severity.alias("severity"), "user_id", "ts", "value"
    )


FINDINGS = """findings as (select event_id as id, json_extract_string(props, '$.k') as rule,
    case when value >= 66 then 'ERROR' when value >= 33 then 'WARNING' else 'INFO' end as severity, user_id, ts, value
    from events where event_type = 'error')"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, line, hits: order lines, hit unless returned."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("hits"))


COVERAGE = "coverage as (select l_orderkey as entity, l_linenumber as line, case when l_returnflag = 'R' then 0 else 1 end as hits from lineitem)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of customers: id, module, signature."""
    rows = read(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("module"), F.round("c_acctbal", 0).cast("long").alias("signature"))
    new = rows.where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 11 == 0, 0).otherwise(F.col("c_nationkey")).alias("module"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(0)).otherwise(F.round("c_acctbal", 0)).cast("long").alias("signature"),
    )
    return old, new


SNAPSHOTS = """olds as (select c_custkey as id, c_nationkey as module, round(c_acctbal, 0)::bigint as signature from customer where c_custkey % 10 <> 0),
news as (select c_custkey as id, case when c_custkey % 11 = 0 then 0 else c_nationkey end as module,
    case when c_custkey % 3 = 0 then 0 else round(c_acctbal, 0) end::bigint as signature from customer where c_custkey % 7 <> 0)"""


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", rank).where("_nth = 1").drop("_nth")
