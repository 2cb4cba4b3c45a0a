"""The given tables in the roles of reviews, item metadata, vectors and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined with their lines as (user_id, item_id, ts)."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(orders, "l_orderkey")
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("l_partkey").cast("string").alias("item_id"),
            F.unix_timestamp("o_orderdate").alias("ts"),
        )
    )


# SQL twin of ``purchases``.
PURCHASES = """purchases AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (user_idx, item_idx, ts): a small catalogue whose items have vectors."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("user_idx"),
        F.get_json_object("props", "$.k").cast("int").alias("item_idx"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
    )


CLICKS = """clicks AS (
  SELECT CAST(user_id AS INTEGER) AS user_idx,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS item_idx,
         epoch_us(ts) AS ts
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("item_idx"), F.col("embedding").alias("vec")
    )
