"""Profiling and quality queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import profile as P
from ..operators import quality as Q
from ..operators.profile import ROW
from .views import D1, D3, D4, Registry, d1, d3, d4, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
COLUMNS = ("o_custkey", "price", "priority", "odate", "status")


def _each(cols, make):
    return " UNION ALL ".join(make(c) for c in cols)


@R.add("profile_null_rate", f"WITH {D1} " + _each(COLUMNS, lambda c: (
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS unique_count, "
    f"round(count(DISTINCT {c}) / count(*), 6) AS unique_ratio FROM d1")))
def profile_null_rate(spark, sf_dir):
    return P.column_stats(d1(spark, sf_dir)).select("column_name", "null_count", F.round("null_rate", 6).alias("null_rate"), "unique_count", "unique_ratio")


@R.add("profile_unique_category", f"WITH {D1} " + _each(COLUMNS, lambda c: (
    f"SELECT '{c}' AS column_name, CASE WHEN r = 1 THEN 'primary_key' WHEN r > 0.8 THEN 'near_unique' WHEN r > 0.2 THEN 'regular' WHEN r > 0 THEN 'categorical' ELSE 'constant' END AS unique_category "
    f"FROM (SELECT count(DISTINCT {c}) / count(*) AS r FROM d1)")))
def profile_unique_category(spark, sf_dir):
    return P.column_stats(d1(spark, sf_dir)).select("column_name", "unique_category")


@R.add("profile_duplicate_rows", "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows")
def profile_duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@R.add("profile_dataset_rollup", f"""WITH {D1}, s AS ({_each(COLUMNS, lambda c: f"SELECT '{c}' AS c, count(DISTINCT {c}) / count(*) AS r, (count(*) - count({c})) / count(*) AS z FROM d1")})
  SELECT coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE r = 1), '') AS pk_candidates, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE r > 0.8 AND r < 1), '') AS near_unique,
    coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE r > 0 AND r <= 0.2), '') AS categorical, coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE z > 0.5), '') AS high_null FROM s""")
def profile_dataset_rollup(spark, sf_dir):
    r = P.dataset_rollup(P.column_stats(d1(spark, sf_dir)))
    return r.select(*[F.array_join(c, ",").alias(c) for c in r.columns])


def _numeric(cols, source):
    return _each(cols, lambda c: (
        f"SELECT '{c}' AS column_name, count({c}) AS values_count, count(*) - count({c}) AS missing_count, count(*) FILTER (WHERE {c} = 0) AS zeroes_count, round(min({c})::DOUBLE, 4) AS \"min\", round(max({c})::DOUBLE, 4) AS \"max\", "
        f"round(sum({c})::DOUBLE, 2) AS \"sum\", round(avg({c}), 4) AS \"avg\", round(stddev_samp({c}), 4) AS \"std\", round(max({c}) - min({c})::DOUBLE, 4) AS \"range\" FROM {source}"))


@R.add("profile_numeric_core", f"WITH {D1} " + _numeric(("o_custkey", "price"), "d1"))
def profile_numeric_core(spark, sf_dir):
    r = lambda c, n=4: F.round(c, n).alias(c)
    return P.numeric_stats(d1(spark, sf_dir)).select("column_name", "values_count", "missing_count", "zeroes_count", r("min"), r("max"), r("sum", 2), r("avg"), r("std"), r("range"))


@R.add("profile_quantiles", f"WITH {D1} " + _each(("o_custkey", "price"), lambda c: (
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}::DOUBLE, 0.05), 4) AS p5, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, "
    f"round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 4) AS iqr FROM d1")))
def profile_quantiles(spark, sf_dir):
    return P.numeric_stats(d1(spark, sf_dir)).select("column_name", *[F.round(c, 4).alias(c) for c in ("p5", "q1", "median", "q3", "p95", "iqr")])


@R.add("profile_skew_kurt", f"WITH {D1} " + _each(("o_custkey", "price"), lambda c: f"SELECT '{c}' AS column_name, round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurt FROM d1"))
def profile_skew_kurt(spark, sf_dir):
    return P.numeric_stats(d1(spark, sf_dir)).select("column_name", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@R.add("profile_histogram", f"""WITH {D1}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM d1),
  b AS (SELECT least(floor((price - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM d1, e WHERE price IS NOT NULL GROUP BY 1)
  SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 10), 4) AS bin_start, coalesce(n, 0) AS n FROM e, range(10) t(i) LEFT JOIN b ON b.bin = i""")
def profile_histogram(spark, sf_dir):
    return P.histogram(d1(spark, sf_dir), "price").select("bin", F.round("bin_start", 4).alias("bin_start"), "n")


def _top(c):
    return (f"SELECT '{c}' AS column_name, least(rk, 6)::INT AS rank, CASE WHEN rk > 5 THEN '(Other)' ELSE value END AS value, sum(n)::BIGINT AS n, round(sum(n) / (SELECT count(*) FROM d1), 4) AS pct FROM ("
            f"SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(_row_index)) AS rk FROM d1 WHERE {c} IS NOT NULL GROUP BY 1) GROUP BY 1, 2, 3")


@R.add("profile_top_frequencies", f"WITH {D1} {_top('priority')} UNION ALL {_top('status')}")
def profile_top_frequencies(spark, sf_dir):
    return P.top_frequencies(d1(spark, sf_dir), ["priority", "status"])


@R.add("profile_format_patterns", f"""WITH {D4}, f AS (SELECT regexp_replace(regexp_replace(since || phone, '[0-9]', 'D', 'g'), '[a-zA-Z]', 'A', 'g') AS format_pattern FROM (SELECT * FROM d4 WHERE phone IS NOT NULL ORDER BY _row_index LIMIT 10000)),
  g AS (SELECT format_pattern, count(*) AS n FROM f GROUP BY 1) SELECT format_pattern, round(n / (SELECT sum(n) FROM g), 6) AS pct FROM g
  WHERE (SELECT count(*) FROM g) BETWEEN 2 AND 15 OR ((SELECT count(*) FROM g) > 15 AND (SELECT max(n) / sum(n) FROM g) >= 0.3) ORDER BY n DESC, format_pattern LIMIT 15""")
def profile_format_patterns(spark, sf_dir):
    df = d4(spark, sf_dir).withColumn("v", F.concat("since", "phone"))
    return P.format_patterns(df, "v").withColumn("pct", F.round("pct", 6))


@R.add("profile_disguised_nulls", f"""WITH {D1}, r(rule) AS (VALUES ('N/A'), ('null'), ('unknown'), ('-'), ('none'), ('0'))
  SELECT 'priority' AS column_name, rule, count(*) AS n FROM d1, r WHERE lower(trim(priority)) = lower(rule) GROUP BY rule""")
def profile_disguised_nulls(spark, sf_dir):
    return P.disguised_nulls(d1(spark, sf_dir), ["priority", "status"])


_RX = [(n, rx.replace("(?i)", "(?i)").replace("(?s)", "(?s)")) for n, rx, _ in X.PATTERNS]


@R.add("profile_pattern_shares", f"WITH {D4} " + " UNION ALL ".join(
    f"SELECT {i} AS precedence, '{n}' AS pattern, round(avg(regexp_full_match(since, '{rx}')::INT), 6) AS share FROM d4" for i, (n, rx) in enumerate(_RX)))
def profile_pattern_shares(spark, sf_dir):
    return P.pattern_shares(d4(spark, sf_dir), "since").withColumn("share", F.round("share", 6))


def _detect(c, of="d4"):
    hits = ", ".join(f"CASE WHEN avg(regexp_full_match({c}, '{rx}')::INT) >= {min(0.7, own)} THEN '{n}' END" for n, rx, own in X.PATTERNS)
    return f"SELECT '{c}' AS column_name, coalesce({hits}) AS pattern FROM {of}"


@R.add("profile_pattern_detect", f"WITH {D4} {_detect('since')} UNION ALL {_detect('phone')} UNION ALL {_detect('city')}")
def profile_pattern_detect(spark, sf_dir):
    return P.detected_pattern(d4(spark, sf_dir), ["since", "phone", "city"])


@R.add("profile_representative_sample", f"""WITH {D4}, g AS (SELECT firm AS value, count(*) AS n, min(_row_index) AS first, min(md5(CAST(_row_index AS VARCHAR))) AS draw FROM d4 WHERE firm IS NOT NULL GROUP BY 1), t AS (SELECT value FROM g ORDER BY n DESC, first LIMIT 10)
  SELECT value FROM t UNION ALL SELECT value FROM (SELECT value FROM g WHERE value NOT IN (SELECT value FROM t) ORDER BY draw LIMIT 10)""")
def profile_representative_sample(spark, sf_dir):
    return P.representative_sample(d4(spark, sf_dir), "firm")


@R.add("fuzzy_profile_columns", f"""WITH {D4}, t AS (SELECT 'firm' AS column_name, trim(regexp_replace(lower(firm), '[^a-z0-9]+', ' ', 'g')) AS v FROM d4 UNION ALL
  SELECT 'email', coalesce(trim(regexp_replace(lower(email), '[^a-z0-9]+', ' ', 'g')), '') FROM d4)
  SELECT column_name, round(count(nullif(v, '')) / count(*), 6) AS non_null_rate, count(DISTINCT nullif(v, '')) AS distinct_normalized, round(count(DISTINCT nullif(v, '')) / count(nullif(v, '')), 6) AS distinct_ratio,
    round(avg(length(nullif(v, ''))), 6) AS avg_length FROM t GROUP BY 1""")
def fuzzy_profile_columns(spark, sf_dir):
    return P.fuzzy_column_profile(d4(spark, sf_dir), ["firm", "email"], ascii_only=True)


@R.add("popular_rows", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_mktsegment, c_nationkey LIMIT 10")
def popular_rows(spark, sf_dir):
    return P.popular_rows(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


_DATE = r"(?i)\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_TIME = r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b|\b\d{1,2}\s*(?:am|pm)\b"


@R.add("vote_temporal", f"""WITH {D3}, v AS (SELECT 'stamp' AS column_name, stamp AS s FROM d3 UNION ALL SELECT 'clock', clock FROM d3),
  n AS (SELECT column_name, count(*) FILTER (WHERE regexp_matches(s, '{_DATE}') AND regexp_matches(s, '{_TIME}')) AS n_date_time, count(*) FILTER (WHERE NOT regexp_matches(s, '{_DATE}') AND regexp_matches(s, '{_TIME}')) AS n_time_only FROM v GROUP BY 1)
  SELECT *, CASE WHEN n_date_time + n_time_only > 0 THEN CASE WHEN n_date_time >= n_time_only THEN 'datetime' ELSE 'time' END END AS expected_type FROM n""")
def vote_temporal(spark, sf_dir):
    return P.temporal_vote(d3(spark, sf_dir), ["stamp", "clock"])


@R.add("vote_numeric", f"""WITH {D4}, v AS (SELECT 'city' AS column_name, city AS s FROM d4 UNION ALL SELECT 'phone', phone FROM d4),
  n AS (SELECT column_name, avg(regexp_full_match(trim(s), '[-+]?\\d+')::INT) AS i, avg(regexp_full_match(trim(s), '[-+]?\\d*\\.?\\d+')::INT) AS f FROM v GROUP BY 1)
  SELECT column_name, round(i, 6) AS int_share, round(f, 6) AS number_share, CASE WHEN i > 0.8 THEN 'int' WHEN f > 0.8 THEN 'float' END AS expected_type FROM n""")
def vote_numeric(spark, sf_dir):
    return P.numeric_vote(d4(spark, sf_dir), ["city", "phone"]).select("column_name", F.round("int_share", 6).alias("int_share"), F.round("number_share", 6).alias("number_share"), "expected_type")


_PLACE = "lower(trim({c})) IN ('n/a', 'null', 'unknown', '-', 'none', '0', '')"


@R.add("qc_report", f"WITH {D1} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS logical_type, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_rate, "
    f"{f'count(*) FILTER (WHERE {_PLACE.format(c=c)})' if t == 'str' else '0::BIGINT'} AS disguised_count, count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) <= 1 AS is_constant FROM d1"
    for c, t in (("o_custkey", "int"), ("price", "float"), ("priority", "str"), ("status", "str"))))
def qc_report(spark, sf_dir):
    return Q.column_quality(d1(spark, sf_dir).drop("odate")).drop("issues")


@R.add("qc_logical_dtype", f"""WITH {D3} SELECT 'odate' AS column_name, CASE WHEN bool_and(date_trunc('day', o_orderdate) = o_orderdate) THEN 'date' ELSE 'datetime' END AS logical_type FROM orders
  UNION ALL SELECT 'clock', CASE WHEN bool_and(regexp_full_match(clock, '([01]\\d|2[0-3]):[0-5]\\d(:[0-5]\\d(\\.\\d+)?)?')) THEN 'time' ELSE 'str' END FROM d3 WHERE _row_index % 4 < 2
  UNION ALL SELECT 'num', 'str'""")
def qc_logical_dtype(spark, sf_dir):
    a = Q.logical_types(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("odate")))
    return a.unionByName(Q.logical_types(d3(spark, sf_dir).where(F.col(ROW) % 4 < 2).select("clock", "num")))


@R.add("qc_passed", f"""WITH {D1} SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, price, priority, odate, status FROM d1)) AS duplicate_rows, 'odate,price' AS null_columns, 'priority' AS disguised_columns, false AS passed FROM d1""")
def qc_passed(spark, sf_dir):
    r = Q.quality_report(d1(spark, sf_dir))
    return r.select("rows", "duplicate_rows", F.array_join("null_columns", ",").alias("null_columns"), F.array_join("disguised_columns", ",").alias("disguised_columns"), "passed")


@R.add("qc_is_unique", "SELECT false AS is_unique")
def qc_is_unique(spark, sf_dir):
    return Q.is_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
