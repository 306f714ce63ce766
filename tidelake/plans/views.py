"""Dirty views of the test tables, made alike in Spark and in oracle SQL, and the registry of queries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import ROW

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and oracle SQL of one module."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


D1 = """d1 AS (SELECT o_orderkey AS _row_index, o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN ' Unknown ' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS odate, o_orderstatus AS status FROM orders)"""


def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls and placeholders by key."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias(ROW), "o_custkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 11 == 0, "N/A").when(k % 13 == 0, " Unknown ").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("odate"), F.col("o_orderstatus").alias("status"))


D2 = """d2 AS (SELECT o_orderkey AS _row_index, o_custkey, o_orderstatus, o_orderpriority FROM orders
  UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 = 0)"""


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every tenth row twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), "o_custkey", "o_orderstatus", "o_orderpriority")
    return o.unionByName(o.where(F.col(ROW) % 10 == 0).withColumn(ROW, F.col(ROW) + 10000000))


D3 = """d3 AS (SELECT o_orderkey AS _row_index,
  CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(o_orderkey AS VARCHAR) || ',000.50 USD' WHEN 1 THEN 'abc' WHEN 2 THEN ' +' || CAST(o_custkey AS VARCHAR) || ' '
    WHEN 3 THEN '-' || CAST(o_custkey AS VARCHAR) || '.25' WHEN 4 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '-6' END AS num,
  CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN NULL ELSE 'F' END AS flag,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN 'not a date' WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y/%m/%d') END AS stamp,
  CASE o_orderkey % 4 WHEN 0 THEN '08:30' WHEN 1 THEN '17:45:15' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 06:07:08' ELSE NULL END AS clock FROM orders)"""


def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, flags, dates and times as dirty strings."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias(ROW),
        F.when(k % 6 == 0, F.concat(F.lit("$"), k.cast("string"), F.lit(",000.50 USD"))).when(k % 6 == 1, "abc").when(k % 6 == 2, F.concat(F.lit(" +"), c, F.lit(" ")))
        .when(k % 6 == 3, F.concat(F.lit("-"), c, F.lit(".25"))).when(k % 6 == 5, F.concat(c, F.lit("-6"))).alias("num"),
        F.when(k % 7 == 0, "Yes").when(k % 7 == 1, " n ").when(k % 7 == 2, "TRUE").when(k % 7 == 3, "0").when(k % 7 == 4, "maybe").when(k % 7 == 6, "F").alias("flag"),
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k % 5 == 1, F.date_format(d, "MM/dd/yyyy")).when(k % 5 == 2, "not a date")
        .when(k % 5 == 4, F.date_format(d, "yyyy/MM/dd")).alias("stamp"),
        F.when(k % 4 == 0, "08:30").when(k % 4 == 1, "17:45:15").when(k % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 06:07:08"))).alias("clock"))


D4 = """d4 AS (SELECT c_custkey AS _row_index,
  CASE c_custkey % 5 WHEN 0 THEN '(0' || CAST(c_custkey % 97 AS VARCHAR) || ') 555-01' || CAST(10 + c_custkey % 13 AS VARCHAR) WHEN 1 THEN '0044 20 7946 0' || CAST(100 + c_custkey % 7 AS VARCHAR) || ' ext 12'
    WHEN 2 THEN '12' WHEN 3 THEN NULL ELSE '555' || CAST(1000 + c_custkey % 11 AS VARCHAR) END AS phone,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ' User.' || CAST(c_custkey % 41 AS VARCHAR) || '@Example' || CAST(c_custkey % 3 AS VARCHAR) || '.COM ' END AS email,
  'Firm ' || c_mktsegment || ' ' || CAST(c_custkey % 37 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN ', Inc.' ELSE ' INC' END AS firm,
  c_nationkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS city,
  CAST(1990 + c_custkey % 30 AS VARCHAR) || '-05-06' AS since FROM customer)"""


def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with phones, e-mails and firm names in several spellings."""
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    return table(spark, sf_dir, "customer").select(
        k.alias(ROW),
        F.when(k % 5 == 0, F.concat(F.lit("(0"), s(k % 97), F.lit(") 555-01"), s(10 + k % 13))).when(k % 5 == 1, F.concat(F.lit("0044 20 7946 0"), s(100 + k % 7), F.lit(" ext 12")))
        .when(k % 5 == 2, "12").when(k % 5 == 4, F.concat(F.lit("555"), s(1000 + k % 11))).alias("phone"),
        F.when(k % 9 != 0, F.concat(F.lit(" User."), s(k % 41), F.lit("@Example"), s(k % 3), F.lit(".COM "))).alias("email"),
        F.concat(F.lit("Firm "), "c_mktsegment", F.lit(" "), s(k % 37), F.when(k % 2 == 0, ", Inc.").otherwise(" INC")).alias("firm"),
        "c_nationkey", "c_mktsegment", F.when(k % 4 != 0, s(F.col("c_nationkey"))).alias("city"), F.concat(s(1990 + k % 30), F.lit("-05-06")).alias("since"))


#: Before: d1. After: d1 with prices and priorities filled. Truth: orders.
D5 = D1 + """, d5a AS (SELECT _row_index, o_custkey, coalesce(price, 1000.0) AS price, CASE WHEN priority IN ('N/A', ' Unknown ') THEN '5-LOW' ELSE priority END AS priority, odate, status FROM d1),
  truth AS (SELECT o_orderkey AS _row_index, o_custkey, o_totalprice AS price, o_orderpriority AS priority, o_orderdate AS odate, o_orderstatus AS status FROM orders)"""


def d5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(before, after, truth)."""
    before = d1(spark, sf_dir)
    after = before.withColumns({"price": F.coalesce("price", F.lit(1000.0)), "priority": F.when(F.col("priority").isin("N/A", " Unknown "), "5-LOW").otherwise(F.col("priority"))})
    truth = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(ROW), "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("odate"), F.col("o_orderstatus").alias("status"))
    return before, after, truth
