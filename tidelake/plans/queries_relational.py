"""SQL forms that Spark lacks, interval joins, quantiles and frequent values."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import heavy
from ..operators import joins as J
from ..operators import ranks
from ..operators import relational as Q
from . import sql_console
from .views import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("sql_qualify", """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 AND count(*) OVER (PARTITION BY o_custkey) > 3""")
def sql_qualify(spark, sf_dir):
    own = Window.partitionBy("o_custkey")
    return Q.qualify(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
                     rank=(F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")), lambda r: r <= 2),
                     n=(F.count(F.lit(1)).over(own), lambda n: n > 3)).drop("o_totalprice")


@R.add("sql_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def sql_distinct_on(spark, sf_dir):
    return Q.distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [Q.descending(F.col("o_totalprice")), F.col("o_orderkey")], ["o_custkey", "o_orderkey", "o_orderstatus"])


@R.add("sql_unnest", """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents) GROUP BY ALL HAVING n > 20""")
def sql_unnest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    words = Q.unnest(docs, word=F.split(F.coalesce("text", F.lit("")), " "))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 20")


@R.add("sql_exclude", "SELECT * EXCLUDE (c_name, c_acctbal) REPLACE (lower(c_mktsegment) AS c_mktsegment) FROM customer")
def sql_exclude(spark, sf_dir):
    return Q.exclude(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], c_mktsegment=F.lower("c_mktsegment"))


_NAMES = "SELECT load, count(*) AS `use`, max({set}) AS grant FROM (SELECT o_custkey AS load, o_orderkey AS {set} FROM orders) GROUP BY load"


@R.add("console_reserved_names", _NAMES.format(set='"set"').replace("`", '"').replace("AS grant", 'AS "grant"').replace("load", '"load"'))
def console_reserved_names(spark, sf_dir):
    """Columns named like statements, through the console."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return sql_console.run(spark, _NAMES.format(set="set"))


_A = "SELECT s_suppkey AS a, floor(s_acctbal) AS lo, floor(s_acctbal) + 200 + s_suppkey % 5 * 400 AS hi FROM supplier UNION ALL SELECT 0, -1000000, 1000000"
_B = "SELECT c_custkey AS b, floor(c_acctbal) AS from_, floor(c_acctbal) + c_custkey % 90 AS to_ FROM customer"


@R.add("overlap_join", f"WITH x AS ({_A}), y AS ({_B}) SELECT a, count(*) AS n, min(b) AS first, max(b) AS last FROM x JOIN y ON lo < to_ AND from_ < hi WHERE lo < hi AND from_ < to_ GROUP BY a")
def overlap_join(spark, sf_dir):
    """Intervals of suppliers, one of which spans all, that overlap those of customers."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    low, start = F.floor("s_acctbal"), F.floor("c_acctbal")
    a = s.select(F.col("s_suppkey").alias("a"), low.alias("lo"), (low + 200 + F.col("s_suppkey") % 5 * 400).alias("hi"))
    a = a.unionByName(spark.range(1).selectExpr("0L AS a", "-1000000L AS lo", "1000000L AS hi"))
    b = c.select(F.col("c_custkey").alias("b"), start.alias("from_"), (start + F.col("c_custkey") % 90).alias("to_"))
    return J.overlap_summary(a, b, "lo", "hi", "from_", "to_", "a", "b")


@R.add("asof_stripes", """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_shipdate AS t, l_extendedprice AS p FROM lineitem WHERE l_linenumber % 2 = 1),
  r AS (SELECT l_returnflag AS k, l_shipdate AS t, max(l_orderkey) AS last_order FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
  SELECT l.k, count(*) AS n, count(last_order) AS found, CAST(sum(last_order) AS BIGINT) AS total FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t GROUP BY l.k""")
def asof_stripes(spark, sf_dir):
    """Three hot keys, each cut into stripes of time."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("k"), F.col("l_shipdate").alias("t"))
    right = lines.where("l_linenumber % 2 = 0").groupBy("k", "t").agg(F.max("l_orderkey").alias("last_order"))
    made = J.asof_join(lines.where("l_linenumber % 2 = 1"), right, "t", ["k"], ["last_order"], stripe_rows=2000)
    return made.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("last_order").alias("found"), F.sum("last_order").alias("total"))


@R.add("quantiles_by_counting", """SELECT unnest([0.0, 0.01, 0.5, 0.99, 1.0]) AS cut, unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.5, 0.99, 1.0])) AS price,
  unnest(quantile_cont(l_quantity, [0.0, 0.01, 0.5, 0.99, 1.0])) AS quantity FROM lineitem""")
def quantiles_by_counting(spark, sf_dir):
    """Both columns' quantiles, with small buffers so that ranges are refined."""
    cuts = [0.0, 0.01, 0.5, 0.99, 1.0]
    found = ranks.exact_quantiles(table(spark, sf_dir, "lineitem"), {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")}, cuts, held=1000)
    return spark.createDataFrame(list(zip(cuts, found["price"], found["quantity"], strict=True)), "cut double, price double, quantity double")


_TOP = "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL ORDER BY n DESC, min(l_orderkey * 10 + l_linenumber) LIMIT 4"


@R.add("top_values_proven", " UNION ALL ".join(f"(SELECT * FROM ({_TOP.format(c=c)}))" for c in ("l_returnflag", "l_linenumber", "l_partkey")))
def top_values_proven(spark, sf_dir):
    """Candidates of summaries, counted exactly; columns without a proof are grouped."""
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.expr("l_orderkey * 10 + l_linenumber"))
    return heavy.top_values(lines, {c: F.col(c) for c in ("l_returnflag", "l_linenumber", "l_partkey")}, 4, "at").drop("first")
