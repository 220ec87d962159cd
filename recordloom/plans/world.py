"""The graph, its timeline and its documents as they follow from the driver's tables: orders are documents, suppliers,
customers and nations are companies, people and addresses. The same definitions as SQL stand beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import table


def entities(spark: SparkSession, d: str) -> DataFrame:
    def of(name, key, prefix, label, kind, offset):
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("type"), (F.col(key).cast("long") + offset).alias("ord"))

    parts = [of("supplier", "s_suppkey", "S", "s_name", "Company", 0), of("customer", "c_custkey", "C", "c_name", "Person", 1_000_000_000_000), of("nation", "n_nationkey", "N", "n_name", "Address", 2_000_000_000_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ENTITIES = """entities AS (SELECT 'S' || s_suppkey AS id, s_name AS name, 'Company' AS type, s_suppkey::BIGINT AS ord FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Person', c_custkey + 1000000000000 FROM customer UNION ALL SELECT 'N' || n_nationkey, n_name, 'Address', n_nationkey + 2000000000000 FROM nation)"""


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey, l_suppkey, a row for each line of an order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_custkey", "l_suppkey")


def appearances(spark: SparkSession, d: str) -> DataFrame:
    """id, sha256 (here the order's key)."""
    buyers = table(spark, d, "orders").select(_id("C", "o_custkey").alias("id"), F.col("o_orderkey").alias("sha256"))
    return buyers.unionByName(table(spark, d, "lineitem").select(_id("S", "l_suppkey").alias("id"), F.col("l_orderkey").alias("sha256"))).distinct()


APPEARANCES = "appearances AS (SELECT 'C' || o_custkey AS id, o_orderkey AS sha256 FROM orders UNION SELECT 'S' || l_suppkey, l_orderkey FROM lineitem)"


def roles(spark: SparkSession, d: str) -> DataFrame:
    """src_id, relationship, target_id."""
    at = lambda name, key, prefix, nation: table(spark, d, name).select(_id(prefix, key).alias("src_id"), F.lit("Located at").alias("relationship"), _id("N", nation).alias("target_id"))
    # distinct by the keys, before they become text
    bought = sales(spark, d).distinct().select(_id("C", "o_custkey").alias("src_id"), F.lit("Ordered from").alias("relationship"), _id("S", "l_suppkey").alias("target_id"))
    return at("supplier", "s_suppkey", "S", "s_nationkey").unionByName(at("customer", "c_custkey", "C", "c_nationkey")).unionByName(bought)


ROLES = """roles AS (SELECT 'S' || s_suppkey AS src_id, 'Located at' AS relationship, 'N' || s_nationkey AS target_id FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'Located at', 'N' || c_nationkey FROM customer
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'Ordered from', 'S' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """sha256, entity_id, date (a day, month or year), event, page, confidence, ord."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    precise = F.substring(day, 1, F.element_at(F.array(F.lit(10), F.lit(7), F.lit(4)), (F.col("o_orderkey") % 3 + 1).cast("int")))
    sure = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.concat(F.lit("D"), (F.col("o_orderkey") % 50).cast("string")).alias("sha256"), _id("C", "o_custkey").alias("entity_id"), precise.alias("date"),
        F.concat(F.lit("Order "), F.col("o_orderstatus"), F.lit(" "), F.col("o_orderpriority")).alias("event"), (F.col("o_orderkey") % 9).cast("int").alias("page"), sure.alias("confidence"), F.col("o_orderkey").alias("ord"),
    )


EVENTS = """events AS (SELECT 'D' || (o_orderkey % 50) AS sha256, 'C' || o_custkey AS entity_id, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, [10, 7, 4][(o_orderkey % 3 + 1)::INT]) AS date,
  'Order ' || o_orderstatus || ' ' || o_orderpriority AS event, (o_orderkey % 9)::INT AS page, ['high', 'medium', 'low', ''][(o_orderkey % 4 + 1)::INT] AS confidence, o_orderkey AS ord FROM orders)"""
EVENT_KEY = "date || '|' || lower(substr(event, 1, 80))"
DATE_KEY = "CASE length(date) WHEN 4 THEN date || '-00-00' WHEN 7 THEN date || '-00' ELSE date END"
