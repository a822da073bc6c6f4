"""The test tables in the roles of ledger tables, in Spark and in SQL.

orders are items, customers owners, nations scopes, events attempts and transitions, conversations transcripts,
documents contents, pages calendar events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = {"1-URGENT": "blocker", "2-HIGH": "risk", "3-MEDIUM": "commitment", "4-NOT SPECIFIED": "open_question", "5-LOW": "milestone"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, scope, kind, title, status, owner, due, updated_at."""
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == p, F.lit(k)) for p, k in KIND.items()))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "active").otherwise("completed")
    owner = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    due = F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item_id"), F.col("c_nationkey").alias("scope"), kind.alias("kind"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"), owner.alias("owner"),
        due.alias("due"), F.col("o_orderdate").alias("updated_at"),
    )


ITEMS = """items AS (
  SELECT o_orderkey AS item_id, c_nationkey AS scope,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'blocker' WHEN '2-HIGH' THEN 'risk' WHEN '3-MEDIUM' THEN 'commitment' WHEN '4-NOT SPECIFIED' THEN 'open_question' ELSE 'milestone' END AS kind,
    'order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'active' ELSE 'completed' END AS status,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS owner, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS due, o_orderdate AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, item_id, at, and the fields an event sets (null: unchanged)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("item_id"), F.col("ts").alias("at"), kind,
        F.when(kind.isin("view", "error"), F.col("event_type")).alias("status"),
        F.when(kind == "click", F.col("event_id") % 17).alias("owner"),
        F.when(kind == "purchase", F.to_date("ts")).alias("due"),
    )


TRANSITIONS = """transitions AS (
  SELECT event_id, user_id AS item_id, ts AS "at", event_type, CASE WHEN event_type IN ('view', 'error') THEN event_type END AS status,
    CASE WHEN event_type = 'click' THEN event_id % 17 END AS owner, CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS due
  FROM events
)"""
