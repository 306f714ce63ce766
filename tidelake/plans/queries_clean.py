"""Casting, imputation and rule queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import cast as C
from ..operators import impute as I
from ..operators import rules as V
from ..operators.profile import ROW
from .views import D1, D3, D4, Registry, d1, d3, d4, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_NUM = "nullif(regexp_extract(replace(trim(num), ',', ''), '([-+]?\\d*\\.?\\d+)', 1), '')"
_STAMP = "coalesce(try_strptime(trim({c}), '%Y-%m-%d %H:%M:%S'), try_strptime(trim({c}), '%Y/%m/%d'), try_strptime(trim({c}), '%m/%d/%Y'))"


@R.add("cast_float", f"WITH {D3} SELECT _row_index, round(TRY_CAST({_NUM} AS DOUBLE), 6) AS num FROM d3")
def cast_float(spark, sf_dir):
    return C.cast_columns(d3(spark, sf_dir).select(ROW, "num"), {"num": "float"}).withColumn("num", F.round("num", 6))


@R.add("cast_int", f"WITH {D3} SELECT _row_index, CAST(round_even(TRY_CAST({_NUM} AS DOUBLE), 0) AS BIGINT) AS num FROM d3")
def cast_int(spark, sf_dir):
    return C.cast_columns(d3(spark, sf_dir).select(ROW, "num"), {"num": "integer"})


@R.add("cast_bool", f"WITH {D3} SELECT _row_index, CASE WHEN lower(trim(flag)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(flag)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag FROM d3")
def cast_bool(spark, sf_dir):
    return C.cast_columns(d3(spark, sf_dir).select(ROW, "flag"), {"flag": "boolean"})


@R.add("cast_str", "SELECT o_orderkey AS _row_index, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_str(spark, sf_dir):
    return C.cast_columns(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), "o_custkey"), {"o_custkey": "text"})


@R.add("cast_datetime", f"WITH {D3} SELECT _row_index, {_STAMP.format(c='stamp')} AS stamp FROM d3")
def cast_datetime(spark, sf_dir):
    return d3(spark, sf_dir).select(ROW, C.to_datetime(F.col("stamp")).alias("stamp"))


@R.add("cast_date", f"WITH {D3} SELECT _row_index, CAST({_STAMP.format(c='stamp')} AS DATE) AS stamp FROM d3")
def cast_date(spark, sf_dir):
    return C.cast_columns(d3(spark, sf_dir).select(ROW, "stamp"), {"stamp": "date"})


@R.add("cast_time", f"""WITH {D3} SELECT _row_index, CASE WHEN clock = '08:30' THEN '08:30:00' WHEN clock = '17:45:15' THEN clock ELSE strftime(try_strptime(clock, '%Y-%m-%d %H:%M:%S'), '%H:%M:%S') END AS clock FROM d3""")
def cast_time(spark, sf_dir):
    return C.cast_columns(d3(spark, sf_dir).select(ROW, "clock"), {"clock": "time"})


@R.add("cast_complete_date", f"""WITH {D3}, f AS (SELECT arg_min(substr(clock, 1, 10), _row_index) FILTER (WHERE clock LIKE '____-%') AS day FROM d3)
  SELECT _row_index, CASE WHEN clock LIKE '__:__' OR clock LIKE '__:__:__' THEN day || ' ' || clock ELSE clock END AS clock FROM d3, f""")
def cast_complete_date(spark, sf_dir):
    return D.complete_dates(d3(spark, sf_dir).select(ROW, "clock"), "clock", ROW)


@R.add("cast_report", f"""WITH {D3} SELECT 'num' AS column_name, 'string' AS dtype_before, 'double' AS dtype_after, count(*) - count(num) AS nulls_before, count(*) - count(TRY_CAST({_NUM} AS DOUBLE)) AS nulls_after,
  greatest(count(num) - count(TRY_CAST({_NUM} AS DOUBLE)), 0) AS coerced_nulls FROM d3 UNION ALL
  SELECT 'flag', 'string', 'boolean', count(*) - count(flag), count(*) - count(CASE WHEN lower(trim(flag)) IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') THEN 1 END), count(*) FILTER (WHERE flag = 'maybe') FROM d3""")
def cast_report(spark, sf_dir):
    before = d3(spark, sf_dir)
    return C.cast_report(before, C.cast_columns(before, {"num": "float", "flag": "bool"}), ["num", "flag"])


@R.add("cast_restore_format", f"WITH {D3} SELECT _row_index, strftime({_STAMP.format(c='stamp')}, '%m/%d/%Y') AS stamp FROM d3")
def cast_restore_format(spark, sf_dir):
    return d3(spark, sf_dir).select(ROW, C.restore_format(C.to_datetime(F.col("stamp")), "%m/%d/%Y").alias("stamp"))


@R.add("null_drop_row", f"WITH {D1} SELECT * FROM d1 WHERE price IS NOT NULL AND odate IS NOT NULL")
def null_drop_row(spark, sf_dir):
    return I.apply_plan(d1(spark, sf_dir), {"price": "drop_row", "odate": "drop_row"}).df


@R.add("null_fill_value", f"WITH {D1} SELECT _row_index, coalesce(price, 12.5) AS price FROM d1")
def null_fill_value(spark, sf_dir):
    return I.apply_plan(d1(spark, sf_dir), {"price": {"strategy": "fill_constant", "fill_value": "12.5"}}).df.select(ROW, "price")


@R.add("null_fill_mean", f"WITH {D1} SELECT _row_index, round(coalesce(price, (SELECT avg(price) FROM d1)), 4) AS price FROM d1")
def null_fill_mean(spark, sf_dir):
    return I.apply_plan(d1(spark, sf_dir), {"price": "fill_mean"}).df.select(ROW, F.round("price", 4).alias("price"))


_HOLES = "h AS (SELECT o_orderkey AS _row_index, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS v, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS p FROM orders)"


def _holes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias(ROW), F.when(k % 3 > 0, F.col("o_custkey")).alias("v"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("p"))


@R.add("null_fill_mean_discrete", f"WITH {_HOLES} SELECT _row_index, coalesce(v, CAST(round_even((SELECT avg(v) FROM h), 0) AS BIGINT)) AS v FROM h")
def null_fill_mean_discrete(spark, sf_dir):
    return I.apply_plan(_holes(spark, sf_dir), {"v": "fill_mean"}).df.select(ROW, "v")


@R.add("null_fill_median", f"WITH {D1} SELECT _row_index, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d1)), 4) AS price FROM d1")
def null_fill_median(spark, sf_dir):
    return I.apply_plan(d1(spark, sf_dir), {"price": "fill_median"}).df.select(ROW, F.round("price", 4).alias("price"))


@R.add("null_fill_mode", f"WITH {_HOLES} SELECT _row_index, coalesce(p, (SELECT p FROM h WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS p FROM h")
def null_fill_mode(spark, sf_dir):
    return I.apply_plan(_holes(spark, sf_dir), {"p": "fill_mode"}).df.select(ROW, "p")


@R.add("null_fill_temporal_mean", f"WITH {D1} SELECT _row_index, coalesce(odate, make_timestamp((SELECT CAST(floor(sum(epoch_us(odate)::HUGEINT) / count(odate)) AS BIGINT) FROM d1))) AS odate FROM d1")
def null_fill_temporal_mean(spark, sf_dir):
    df = d1(spark, sf_dir)
    total = df.agg(F.sum(D.micros(F.col("odate")).cast("decimal(38,0)")).alias("s"), F.count("odate").alias("n"))
    mean = D.from_micros(F.floor(F.col("s") / F.col("n")))
    return df.join(F.broadcast(total)).select(ROW, F.coalesce("odate", mean).alias("odate"))


@R.add("null_fill_temporal_median", f"WITH {D1} SELECT _row_index, coalesce(odate, make_timestamp((SELECT CAST(floor(quantile_cont(epoch_us(odate), 0.5)) AS BIGINT) FROM d1))) AS odate FROM d1")
def null_fill_temporal_median(spark, sf_dir):
    return I.apply_plan(d1(spark, sf_dir), {"odate": "fill_median"}).df.select(ROW, "odate")


@R.add("null_sequential_plan", f"""WITH {D1}, a AS (SELECT * FROM d1 WHERE odate IS NOT NULL), m AS (SELECT quantile_cont(price, 0.5) AS m FROM a)
  SELECT _row_index, round(coalesce(price, m), 4) AS price, priority FROM a, m""")
def null_sequential_plan(spark, sf_dir):
    plan = {"odate": "drop_row", "price": "fill_median", "priority": "keep_null", "status": "drop_column", "nope": "fill_mean"}
    return I.apply_plan(d1(spark, sf_dir), plan).df.select(ROW, F.round("price", 4).alias("price"), "priority")


@R.add("null_counts", f"WITH {D1} SELECT 'price' AS column_name, count(*) - count(price) AS nulls FROM d1 UNION ALL SELECT 'odate', count(*) - count(odate) FROM d1")
def null_counts(spark, sf_dir):
    return I.null_counts(d1(spark, sf_dir), ["price", "odate"])


def _rule(name, rule, sql, source=d1, strategies=None):
    @R.add(name, sql)
    def check(spark, sf_dir, rule=rule):
        return V.validate(source(spark, sf_dir), [rule], strategies).select("violations", "passed")

    return check


_V = "SELECT v AS violations, v = 0 AS passed FROM (SELECT {v} AS v FROM d1)"
_rule("rule_duplicate_rows", {"rule": "duplicate_rows_eq_0"}, f"WITH {D1} SELECT v AS violations, v = 0 AS passed FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, price, priority, odate, status FROM d1)) AS v FROM d1)")
_rule("rule_column_unique", {"rule": "column_unique", "column": "o_custkey"}, f"WITH {D1} SELECT v AS violations, v = 0 AS passed FROM (SELECT sum(n)::BIGINT AS v FROM (SELECT count(*) AS n FROM d1 GROUP BY o_custkey) WHERE n > 1)")
_rule("rule_null_rate", {"rule": "null_rate_lt", "column": "price", "threshold": 0.1}, f"WITH {D1} {_V.format(v='((count(*) - count(price)) / count(*) > 0.1)::BIGINT')}")
_rule("rule_no_exact_duplicates", {"rule": "dataframe_no_exact_duplicates"}, f"WITH {D1} SELECT v AS violations, v = 0 AS passed FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, price, priority, odate, status FROM d1)) AS v FROM d1)")
_rule("rule_disguised", {"rule": "no_disguised_missing_values", "column": "priority", "values": ["N/A", " Unknown "], "acknowledged": "N/A"}, f"WITH {D1} {_V.format(v='''count(*) FILTER (WHERE priority = ' Unknown ')''')}")
_rule("rule_pattern", {"rule": "expected_str_pattern", "column": "priority", "pattern": r"\d-[A-Z]+", "fill_value": "Unknown"}, "SELECT 1::BIGINT AS violations, false AS passed")


@R.add("rule_set", f"""WITH {D1} SELECT 'null_rate_lte' AS rule, 'price' AS "column", ((count(*) - count(price)) / count(*) > 0.5)::BIGINT AS violations, (count(*) - count(price)) / count(*) <= 0.5 AS passed FROM d1
  UNION ALL SELECT 'no_unresolved_groups', NULL, 0, true UNION ALL SELECT 'null_rate_lt', 'odate', 0, true""")
def rule_set(spark, sf_dir):
    rules = [{"rule": "null_rate_lte", "column": "price", "threshold": 0.5}, {"rule": "no_unresolved_groups"}, {"rule": "null_rate_lt", "column": "odate", "threshold": 0.0}]
    return V.validate(d1(spark, sf_dir), rules, {"odate": "leave_as_is"}).select("rule", "column", "violations", "passed")


@R.add("scalar_normalizers", f"""WITH {D4} SELECT _row_index, trim(regexp_replace(lower(firm), '[^a-z0-9]+', ' ', 'g')) AS text_form, regexp_replace(regexp_replace(firm, '[0-9]', 'D', 'g'), '[a-zA-Z]', 'A', 'g') AS format_form,
  CASE WHEN phone IS NULL OR lower(trim(phone)) IN ('', 'nan', 'none', 'null', 'nat') THEN '__null__' ELSE trim(phone) END AS diff_form, nullif(regexp_replace(lower(trim(email)), '\\.0$', ''), '') AS score_form FROM d4""")
def scalar_normalizers(spark, sf_dir):
    return d4(spark, sf_dir).select(ROW, X.normal_text(F.col("firm")).alias("text_form"), X.abstract_format(F.col("firm")).alias("format_form"),
                                    X.diff_text(F.col("phone")).alias("diff_form"), X.score_text(F.col("email")).alias("score_form"))
