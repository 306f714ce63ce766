"""Suggestion and look-up queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import alike as L
from ..operators import grid as G
from ..operators import profile as P
from ..scratch import scratch_path
from . import suggest as U
from .lineage import LineageStore
from .queries_dedup import ALL, EVIDENCE, PHONE_KEY, TEXT, WHOLE, evidence_sql
from .specs import ColumnSpec
from .views import D1, D4, Registry, d1, d4, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) / count(*) AS r, (count(*) - count({c})) / count(*) AS z FROM d1" for c in ("o_custkey", "price", "priority", "odate", "status"))


@R.add("suggest_key_sets", f"""WITH {D1}, s AS ({_STATS}), o AS (SELECT c AS key_set, round(r, 6) AS unique_ratio, 0 AS k FROM s WHERE z <= 0.3 AND r > 0.8
  UNION ALL SELECT a.c || ',' || b.c, greatest(round(a.r, 6), round(b.r, 6)), 1 FROM s a JOIN s b ON a.c < b.c WHERE a.z <= 0.3 AND b.z <= 0.3 AND a.r > 0.2 AND a.r <= 0.8 AND b.r > 0.2 AND b.r <= 0.8)
  SELECT key_set, unique_ratio FROM o ORDER BY k, unique_ratio DESC, key_set LIMIT 8""")
def suggest_key_sets(spark, sf_dir):
    return U.key_sets(P.column_stats(d1(spark, sf_dir)))


@R.add("fuzzy_top_values", f"WITH {D4} SELECT 'firm' AS column_name, {TEXT.format(c='firm')} AS value, count(*) AS n FROM d4 GROUP BY 2 ORDER BY n DESC, value LIMIT 5")
def fuzzy_top_values(spark, sf_dir):
    return U.top_normal_values(d4(spark, sf_dir), ["firm"], ascii_only=True)


@R.add("fuzzy_resolution_counts", f"SELECT resolution, count(*) AS n FROM ({evidence_sql(ALL)}) GROUP BY 1")
def fuzzy_resolution_counts(spark, sf_dir):
    return L.resolution_counts(d4(spark, sf_dir), WHOLE, [EVIDENCE])


SPECS = {"email": ColumnSpec("str", "Structured text", logical_group="contact"), "phone": ColumnSpec("str", "Structured text", logical_group="contact"), "age": ColumnSpec("int", "Discrete", logical_group="person")}


@R.add("spec_search", "SELECT * FROM (VALUES ('email'), ('phone')) t(column_name)")
def spec_search(spark, sf_dir):
    return U.search_specs(U.spec_table(spark, SPECS), "STRUCT", "contact").select("column_name")


@R.add("spec_groups", "SELECT * FROM (VALUES ('contact', 'email,phone'), ('person', 'age')) t(logical_group, columns)")
def spec_groups(spark, sf_dir):
    return U.groups(U.spec_table(spark, SPECS)).select("logical_group", F.array_join("columns", ",").alias("columns"))


@R.add("spec_errors_first", "SELECT * FROM (VALUES ('age', true, 1), ('email', false, 1), ('phone', false, 1)) t(column_name, is_error, n_errors)")
def spec_errors_first(spark, sf_dir):
    return U.failed_first(U.spec_table(spark, SPECS), ["age"]).select("column_name", "is_error", "n_errors")


_CATEGORY = "CASE WHEN r = 1 THEN 'primary_key' WHEN r > 0.8 THEN 'near_unique' WHEN r > 0.2 THEN 'regular' WHEN r > 0 THEN 'categorical' ELSE 'constant' END"
_D1_COLUMNS = ["o_custkey", "price", "priority", "odate", "status"]


def _profiled(spark, sf_dir):
    return U.profiled_specs(P.column_stats(d1(spark, sf_dir).select(P.ROW, *_D1_COLUMNS)), _D1_COLUMNS)


@R.add("spec_search_profiled", f"WITH {D1}, s AS ({_STATS}) SELECT c AS column_name, {_CATEGORY} AS semantic_type FROM s WHERE {_CATEGORY} = 'categorical' AND contains(c, 'o')")
def spec_search_profiled(spark, sf_dir):
    """Specs derived from a table, searched by text and group."""
    found = U.search_specs(_profiled(spark, sf_dir).withColumns({"expected_type": F.lit(""), "semantic_type": F.lit(""), "description": F.lit("")}), "O", "categorical")
    return found.select("column_name", F.col("logical_group").alias("semantic_type"))


@R.add("spec_groups_profiled", f"WITH {D1}, s AS ({_STATS}), o AS (SELECT c, r, list_position({_D1_COLUMNS}, c) AS p FROM s) SELECT {_CATEGORY} AS logical_group, string_agg(c, ',' ORDER BY p) AS columns FROM o GROUP BY 1")
def spec_groups_profiled(spark, sf_dir):
    return U.groups(_profiled(spark, sf_dir)).select("logical_group", F.array_join("columns", ",").alias("columns"))


@R.add("spec_errors_first_profiled", f"WITH {D1}, s AS ({_STATS}) SELECT c AS column_name, z > 0 AS is_error, count(*) FILTER (WHERE z > 0) OVER () AS n_errors, row_number() OVER (ORDER BY (z > 0) DESC, list_position({_D1_COLUMNS}, c)) AS place FROM s")
def spec_errors_first_profiled(spark, sf_dir):
    """Columns with nulls first, else in the table's order; a row for each column."""
    specs = _profiled(spark, sf_dir)
    failed = [r[0] for r in specs.where("description != 'nulls: 0'").select("column_name").collect()]
    place = F.row_number().over(Window.orderBy(F.desc("is_error"), "pos"))
    return U.failed_first(specs, failed).select("column_name", "is_error", "n_errors", place.alias("place"))


@R.add("ui_distinct_values", f"WITH {D1} SELECT DISTINCT 'priority' AS column_name, coalesce(priority, '(blanks)') AS value FROM d1")
def ui_distinct_values(spark, sf_dir):
    return G.distinct_values(d1(spark, sf_dir), ["priority"])


@R.add("profile_sorted_by_missing", f"WITH {D1}, s AS ({_STATS}) SELECT c AS column_name, round(z, 6) AS null_rate FROM s ORDER BY z DESC, c LIMIT 3")
def profile_sorted_by_missing(spark, sf_dir):
    return P.column_stats(d1(spark, sf_dir)).orderBy(F.desc("null_rate"), "column_name").limit(3).select("column_name", F.round("null_rate", 6).alias("null_rate"))


@R.add("missing_total", f"WITH {D1} SELECT (count(*) - count(price)) + (count(*) - count(odate)) + (count(*) - count(priority)) + (count(*) - count(status)) + (count(*) - count(o_custkey)) AS missing FROM d1")
def missing_total(spark, sf_dir):
    return P.column_stats(d1(spark, sf_dir)).agg(F.sum("null_count").alias("missing"))


@R.add("batch_append_union", "SELECT version, count(*) AS n, count(b) AS n_second FROM (SELECT 1 AS version, o_orderkey AS a, NULL AS b FROM orders UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY version")
def batch_append_union(spark, sf_dir):
    """Two batches, the second with a column more, published as one version."""
    o = table(spark, sf_dir, "orders")
    store = LineageStore(spark, scratch_path(spark, "append"))
    first, second = o.select("o_orderkey"), o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")
    n = store.append_chunks("s", [first, second], "ingest")
    return store.read("s").agg(F.lit(n).alias("version"), F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("n_second"))


_RANKED = " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) / count(*) AS r FROM d1" for c in ("o_custkey", "priority", "status"))


@R.add("popular_ranked_columns", f"WITH {D1} SELECT column_name, row_number() OVER (ORDER BY r, column_name) AS rank FROM (SELECT c AS column_name, r FROM ({_RANKED})) QUALIFY rank <= 2")
def popular_ranked_columns(spark, sf_dir):
    stats = P.column_stats(d1(spark, sf_dir).select(P.ROW, "o_custkey", "priority", "status"))
    return P.ranked_columns(stats, 2)


@R.add("popular_sample", f"""WITH {D1}, g AS (SELECT coalesce(d1.priority, '') AS priority, status, row_number() OVER (ORDER BY count(*) DESC, d1.priority NULLS FIRST, status) AS p FROM d1 GROUP BY d1.priority, status), h AS (SELECT o_custkey, row_number() OVER (ORDER BY _row_index) AS p FROM d1)
  SELECT g.priority, g.status, h.o_custkey FROM g JOIN h USING (p) WHERE p <= 4""")
def popular_sample(spark, sf_dir):
    """The most frequent combinations of the columns that repeat most, beside the first values of the others."""
    df = d1(spark, sf_dir).select(P.ROW, "o_custkey", "priority", "status")
    return P.popular_sample(df, P.column_stats(df), columns=2, k=4).select(F.coalesce("priority", F.lit("")).alias("priority"), "status", "o_custkey")


@R.add("sql_functions", f"WITH {D4} SELECT _row_index, regexp_replace(regexp_replace(firm, '[0-9]', 'D', 'g'), '[a-zA-Z]', 'A', 'g') AS format_form, lower(trim(email)) AS email_form, {PHONE_KEY} AS phone_form FROM d4")
def sql_functions(spark, sf_dir):
    X.register(spark)
    d4(spark, sf_dir).createOrReplaceTempView("contacts")
    return spark.sql("SELECT _row_index, abstract_format(firm) AS format_form, normalize_email(email) AS email_form, normalize_phone(phone) AS phone_form FROM contacts")
