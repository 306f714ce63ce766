"""Deep pages of a sorted grid, and profiles kept with versions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sketches as S
from ..operators.pages import SortedGrid
from ..operators.profile import ROW
from ..scratch import scratch_path
from .lineage import LineageStore
from .report import step_changes
from .views import D1, Registry, d1

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: (skip, size) of the pages that are asked for.
PAGES = ((0, 25), (700, 100), (1450, 100))
_PAGE = " OR ".join(f"(place >= {skip} AND place < {skip + size})" for skip, size in PAGES)


@R.add("ui_deep_pages", f"""WITH {D1}, ordered AS (SELECT 'all' AS grid, _row_index, price, row_number() OVER (ORDER BY price IS NULL, price DESC, _row_index) - 1 AS place FROM d1
  UNION ALL SELECT 'open', _row_index, price, row_number() OVER (ORDER BY price IS NULL, price DESC, _row_index) - 1 FROM d1 WHERE status = 'O')
  SELECT grid, _row_index, price FROM ordered WHERE {_PAGE}""")
def ui_deep_pages(spark, sf_dir):
    whole = SortedGrid.build(d1(spark, sf_dir), scratch_path(spark, "grid"), "price", descending=True)
    grids = {"all": whole, "open": whole.filtered(F.col("status") == "O")}
    return reduce(DataFrame.unionByName, [g.page(skip, size).select(F.lit(name).alias("grid"), ROW, "price") for name, g in grids.items() for skip, size in PAGES])


def _versions(spark, sf_dir) -> LineageStore:
    """Two versions of orders: as they came, and with prices filled and without cancelled placeholders."""
    store = LineageStore(spark, scratch_path(spark, "profiled"), profiles=True)
    store.append("orders", d1(spark, sf_dir), "ingest")
    store.append("orders", store.read("orders").where(F.coalesce(F.trim("priority") != "Unknown", F.lit(True))).fillna({"price": 1000.0}), "clean")
    return store


_COLUMNS = ("o_custkey", "price", "priority", "odate", "status")
_BEFORE_AFTER = f"""WITH {D1}, clean AS (SELECT * REPLACE (coalesce(price, 1000.0) AS price) FROM d1 WHERE coalesce(trim(priority) <> 'Unknown', true))"""


@R.add("version_profiles", _BEFORE_AFTER + ", both_of AS (SELECT * FROM d1 UNION ALL SELECT * FROM clean) " + " UNION ALL ".join(
    f"SELECT '{s}' AS versions, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, true AS distinct_within, true AS median_within FROM {t}"
    for s, t in (("1", "d1"), ("2", "clean"), ("1, 2", "both_of")) for c in _COLUMNS))
def version_profiles(spark, sf_dir):
    """Profiles of versions and of their union, from what is kept with them, and whether estimates are within their bounds of exact counts."""
    store, parts = _versions(spark, sf_dir), []
    for of in ((1,), (2,), (1, 2)):
        rows = reduce(DataFrame.unionByName, [store.read("orders", n) for n in of])
        told = S.estimated(store.profile("orders", *of))
        medians = {r["column_name"]: r["m"] for r in told.where(F.col("deciles").isNotNull()).select("column_name", F.get("deciles", F.lit(4)).alias("m")).collect()}  # a row a column
        ranks = {c: (F.count_if(F.col(c) < m), F.count_if(F.col(c) <= m)) for c, m in medians.items()}
        unknown = (F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
        exact = rows.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n"), F.count(c).alias("held"), *[x.alias(k) for k, x in zip(("less", "upto"), ranks.get(c, unknown), strict=True)])
                                   for c in _COLUMNS]).alias("a")).select(F.inline("a"))
        near = (F.col("less") <= F.col("held") * 0.52) & (F.col("upto") >= F.col("held") * 0.48)
        parts.append(told.join(exact, "column_name").select(
            F.lit(", ".join(map(str, of))).alias("versions"), "column_name", "n_rows", "n_nulls", (F.abs(F.col("distinct_estimate") - F.col("n")) <= 0.04 * F.col("n")).alias("distinct_within"), F.coalesce(near, F.lit(True)).alias("median_within")))
    return reduce(DataFrame.unionByName, parts)


@R.add("version_profile_changes", _BEFORE_AFTER + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, 'kept' AS state, (SELECT count(*) FROM clean) - (SELECT count(*) FROM d1) AS rows_delta,
  round((SELECT avg(({c} IS NULL)::INT) FROM clean) - (SELECT avg(({c} IS NULL)::INT) FROM d1), 9) AS null_rate_delta""" for c in _COLUMNS))
def version_profile_changes(spark, sf_dir):
    return _versions(spark, sf_dir).profile_change("orders", 1, 2).select("column_name", "state", "rows_delta", F.round("null_rate_delta", 9).alias("null_rate_delta"))


@R.add("report_step_changes", _BEFORE_AFTER + " " + " UNION ALL ".join(
    f"""SELECT 2 AS version, 'clean' AS agent_name, '{c}' AS column_name, (SELECT count(*) FROM d1 a JOIN clean b USING (_row_index) WHERE a.{c} IS DISTINCT FROM b.{c}) AS changed_cells,
  (SELECT count(*) FROM d1 WHERE _row_index NOT IN (SELECT _row_index FROM clean)) AS removed_rows""" for c in _COLUMNS))
def report_step_changes(spark, sf_dir):
    return step_changes(_versions(spark, sf_dir), "orders")
