"""Inputs of the registered queries, derived from the given tables.

Each derived table is one SQL text that Spark and DuckDB both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SESSION_SEED = 123456789
MASTER = "Master Node"
HEARTBEAT_HOURS = 6

LEDGER_SQL = f"""
SELECT o_orderkey AS chunk_id,
       CASE WHEN o_custkey % 7 = 0 THEN '{MASTER}'
            ELSE concat('Worker-', CAST(o_custkey % 7 AS VARCHAR(20))) END AS worker_name,
       CAST(o_custkey % 7 + 2 AS INT) AS threads,
       (CAST({SESSION_SEED} AS BIGINT) * 1000003
         + (o_orderkey % 1000000000) * CAST(2654435761 AS BIGINT)) % 1000000000 AS seed,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE {SESSION_SEED} END AS BIGINT) AS session_seed,
       CAST(floor(o_totalprice) AS BIGINT) AS n_items,
       CAST(floor(o_totalprice * 10) AS BIGINT) AS sort_us,
       CAST(floor(o_totalprice * 10) AS BIGINT) + o_custkey % 1000 AS roundtrip_us
FROM orders"""

HISTORY_SQL = """
SELECT o_custkey AS dataset_id, o_orderkey AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'serial' WHEN 'O' THEN 'distributed' ELSE 'local' END AS mode,
       o_orderdate AS started_at,
       CAST(o_orderkey % 4 + 1 AS INT) AS k,
       CAST(floor(o_totalprice) AS BIGINT) AS compute_us
FROM orders"""

BEATS_SQL = """
SELECT concat('src-', CAST(user_id AS VARCHAR(20))) AS name,
       CAST(5000 AS INT) AS port,
       CASE WHEN event_id % 11 = 0 THEN '127.0.0.1' ELSE '10.0.0.1' END AS host,
       ts
FROM events"""

SHARES_SQL = """
SELECT s_nationkey AS grp, s_suppkey AS ord, s_suppkey % 16 + 1 AS weight FROM supplier"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """``sql`` over the one table ``name``, without registering a view."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare values with many duplicates."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"))


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under a unique order key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("v"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", LEDGER_SQL)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", HISTORY_SQL)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "events", BEATS_SQL)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "supplier", SHARES_SQL)
