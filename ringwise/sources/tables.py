"""Table sources: object catalogs, request logs, members and their stand-ins among the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weighted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, weight)`` from suppliers: their balance, non-positive ones weigh 1."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("node_id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(F.lit(1.0)).alias("weight"))


def equal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(node_id, weight)`` from nations, all of weight 1."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node_id"), F.lit(1.0).alias("weight"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, addr, weight, role, state)`` from customers, role and state by remainders; a fifth has no address."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (k % 250).cast("string"), F.lit(":"), (8000 + k % 7).cast("string"))).alias("addr"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(1.0)).alias("weight"), (k % 3).cast("int").alias("role"), (k % 4).cast("int").alias("state"),
    )


#: The same members in SQL.
MEMBERS_SQL = """select c_name as id, case when c_custkey % 5 = 0 then '' else '10.0.0.' || (c_custkey % 250) || ':' || (8000 + c_custkey % 7) end as addr,
  case when c_acctbal > 0 then c_acctbal else 1.0 end as weight, (c_custkey % 3)::INTEGER as role, (c_custkey % 4)::INTEGER as state from customer"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, ts, node, file, source, outcome, value, bytes, coalesced)`` from events."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("node"), kind.alias("file"),
        F.when(kind.isin("click", "view"), "cache").when(kind.isin("signup", "purchase"), "peer").otherwise("origin").alias("source"),
        (kind == "error").alias("failed"), "value", F.floor(F.col("value") * 1024).cast("bigint").alias("bytes"), (F.col("event_id") % 3 == 0).alias("coalesced"),
    )


LOG_SQL = """select event_id, ts, user_id as node, event_type as file,
  case when event_type in ('click', 'view') then 'cache' when event_type in ('signup', 'purchase') then 'peer' else 'origin' end as source,
  event_type = 'error' as failed, value, floor(value * 1024)::BIGINT as bytes, event_id % 3 = 0 as coalesced from events"""
