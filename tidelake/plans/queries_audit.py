"""Versions, diffs, scores, joins and SQL queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as A
from ..operators import joins as J
from ..operators import fuzzy as Z
from ..operators.profile import ROW
from ..scratch import scratch_path
from . import report, sql_console
from . import suggest as U
from .lineage import LineageStore
from .views import D1, D5, Registry, d1, d5, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
COLS = ("o_custkey", "price", "priority", "odate", "status")


def _store(spark, sf_dir):
    before, after, truth = d5(spark, sf_dir)
    store = LineageStore(spark, scratch_path(spark, "lineage"))
    store.append("s", before, "ingest", "first")
    store.append("s", after, "null_handling", "filled")
    return store


def _console(spark, sf_dir, query, *tables):
    """A query through the console, on the named tables as views."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return sql_console.run(spark, query)


@R.add("lineage_latest", f"WITH {D5} SELECT * FROM d5a")
def lineage_latest(spark, sf_dir):
    return _store(spark, sf_dir).read("s")


@R.add("lineage_time_travel", f"WITH {D5} SELECT * FROM d1")
def lineage_time_travel(spark, sf_dir):
    return _store(spark, sf_dir).read("s", 1)


_VERSION = "SELECT {n} AS version, '{agent}' AS agent_name, '{said}' AS description, count(*) AS n_rows, count(*) FILTER (WHERE price IS NULL) AS null_prices FROM {t}"


@R.add("lineage_versions", f"WITH {D5} {_VERSION.format(n=1, agent='ingest', said='first', t='d1')} UNION ALL {_VERSION.format(n=2, agent='null_handling', said='filled', t='d5a')}")
def lineage_versions(spark, sf_dir):
    store, out = _store(spark, sf_dir), None
    for r in store.versions("s").collect():  # a row for each version
        told = [F.lit(r[c]).alias(c) for c in ("version", "agent_name", "description")]
        one = store.read("s", r["version"]).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("price").isNull()).alias("null_prices")).select(*told, "n_rows", "null_prices")
        out = one if out is None else out.unionByName(one)
    return out


def _norm(x):
    return f"CASE WHEN {x} IS NULL OR lower(trim(CAST({x} AS VARCHAR))) IN ('', 'nan', 'none', 'null', 'nat') THEN '__null__' ELSE trim(CAST({x} AS VARCHAR)) END"


def _change(c):
    return (f"SELECT '{c}' AS column_name, count(*) AS compared, count(*) FILTER (WHERE {_norm('a.' + c)} <> {_norm('b.' + c)}) AS changed_cells, round(count(*) FILTER (WHERE {_norm('a.' + c)} <> {_norm('b.' + c)}) / count(*), 4) AS change_rate, "
            f"count(*) FILTER (WHERE {_norm('a.' + c)} = '__null__') AS before_nulls, count(*) FILTER (WHERE {_norm('b.' + c)} = '__null__') AS after_nulls FROM d1 a JOIN d5a b USING (_row_index)")


_CHANGES = " UNION ALL ".join(map(_change, COLS))


@R.add("diff_column_summary", f"WITH {D5} {_CHANGES}")
def diff_column_summary(spark, sf_dir):
    before, after, _ = d5(spark, sf_dir)
    return A.column_changes(before, after).drop("null_delta", "before_dtype", "after_dtype")


@R.add("diff_by_row_index", f"WITH {D5} {_change('price')}")
def diff_by_row_index(spark, sf_dir):
    before, after, _ = d5(spark, sf_dir)
    return A.column_changes(before, after, ["price"], align="row_index").drop("null_delta", "before_dtype", "after_dtype")


@R.add("diff_top_columns", f"WITH {D5} SELECT column_name, changed_cells FROM ({_CHANGES}) WHERE changed_cells > 0 ORDER BY changed_cells DESC, column_name LIMIT 2")
def diff_top_columns(spark, sf_dir):
    before, after, _ = d5(spark, sf_dir)
    return A.top_changed(A.column_changes(before, after), 2).select("column_name", "changed_cells")


@R.add("diff_preview_cells", f"""WITH {D5}, p AS (SELECT *, row_number() OVER (ORDER BY _row_index) - 1 AS _pos FROM d1), p2 AS (SELECT *, row_number() OVER (ORDER BY _row_index) - 1 AS _pos FROM d5a)
  SELECT p._pos, 'priority' AS column_name, p.priority AS before, p2.priority AS after FROM p JOIN p2 USING (_pos) WHERE p._pos < 50 AND {_norm('p.priority')} <> {_norm('p2.priority')}""")
def diff_preview_cells(spark, sf_dir):
    before, after, _ = d5(spark, sf_dir)
    return A.changed_cells(before, after, ["priority"], limit=50)


@R.add("diff_samples", f"""WITH {D5}, p AS (SELECT *, row_number() OVER (ORDER BY _row_index) - 1 AS _pos FROM d1), c AS (SELECT _pos, p.priority AS before, b.priority AS after FROM p JOIN d5a b USING (_row_index) WHERE {_norm('p.priority')} <> {_norm('b.priority')} ORDER BY _pos LIMIT 3)
  SELECT 'priority' AS column_name, string_agg(_pos || ':' || before || '>' || after, ',' ORDER BY _pos) AS samples FROM c""")
def diff_samples(spark, sf_dir):
    before, after, _ = d5(spark, sf_dir)
    s = A.change_samples(before, after, 3, columns=["priority"])
    return s.select("column_name", F.array_join(F.transform("samples", lambda x: F.concat(x["_pos"].cast("string"), F.lit(":"), x["before"], F.lit(">"), x["after"])), ",").alias("samples"))


def _score(c):
    n = lambda s: f"nullif(nullif(nullif(nullif(regexp_replace(lower(trim(CAST({s}.{c} AS VARCHAR))), '\\.0$', ''), 'nan'), 'none'), ''), 'empty')"
    d, x, t = n("a"), n("b"), n("t")
    return (f"({d} IS DISTINCT FROM {t} AND {x} IS NOT DISTINCT FROM {t})::BIGINT", f"({x} IS DISTINCT FROM {t} AND {x} IS DISTINCT FROM {d})::BIGINT",
            f"({d} IS DISTINCT FROM {t} AND {x} IS DISTINCT FROM {t})::BIGINT", f"({x} IS NOT DISTINCT FROM {t})::BIGINT")


_PARTS = [_score(c) for c in COLS]
_SUM = [f"sum({' + '.join(p[i] for p in _PARTS)})::BIGINT" for i in range(4)]


@R.add("eval_f1", f"""WITH {D5}, s AS (SELECT count(*) * 5 AS cells, {_SUM[0]} AS tp, {_SUM[1]} AS fp, {_SUM[2]} AS fn, {_SUM[3]} AS correct FROM d1 a JOIN d5a b USING (_row_index) JOIN truth t USING (_row_index))
  SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1, round(correct / cells, 6) AS cell_accuracy FROM s""")
def eval_f1(spark, sf_dir):
    r = A.score(*d5(spark, sf_dir))
    return r.select("cells", "tp", "fp", "fn", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "cell_accuracy")])


@R.add("resolve_join_gt", f"WITH {D5} SELECT t.o_custkey, t.status, t.price FROM (SELECT o_custkey, status FROM d1 WHERE price IS NULL) d JOIN truth t ON d.o_custkey = t.o_custkey AND d.status = t.status")
def resolve_join_gt(spark, sf_dir):
    before, _, truth = d5(spark, sf_dir)
    return J.truth_for_nulls(before, truth, "price", ["o_custkey", "status"])


_NEAR = "abs(v - {x}) <= 1e-3 * greatest(abs(v), abs({x})) OR round_even({x}, 0) = v"


@R.add("resolve_fill_strategy", f"""WITH s AS (SELECT s_suppkey AS k, CAST(power(s_suppkey % 10, 3) AS BIGINT) AS x, s_suppkey % 6 = 0 AS hole FROM supplier),
  st AS (SELECT avg(x) AS mean, quantile_cont(x, 0.5) AS median FROM s WHERE NOT hole), m AS (SELECT x AS mode FROM s WHERE NOT hole GROUP BY x ORDER BY count(*) DESC, x LIMIT 1),
  c AS (SELECT 'a_mean' AS kind, CAST(round(mean) AS BIGINT) AS v FROM st UNION ALL SELECT 'a_median', CAST(round(median) AS BIGINT) FROM st UNION ALL SELECT 'a_mode', mode FROM m UNION ALL SELECT 'other', 99999)
  SELECT kind, (SELECT count(*) FROM s WHERE hole) AS n_holes, CASE WHEN {_NEAR.format(x='mean')} THEN 'fill_mean' WHEN {_NEAR.format(x='median')} THEN 'fill_median' WHEN v = mode THEN 'fill_mode' ELSE 'fill_value' END AS strategy, v AS value FROM c, st, m""")
def resolve_fill_strategy(spark, sf_dir):
    """What four different truths of the same holes are explained by."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias(ROW), F.pow(k % 10, F.lit(3)).cast("bigint").alias("x"), (k % 6 == 0).alias("hole"))
    dirty = s.select(ROW, F.when(~F.col("hole"), F.col("x")).alias("v"))
    told = dirty.agg(F.round(F.avg("v")).cast("bigint").alias("a_mean"), F.round(F.percentile("v", 0.5)).cast("bigint").alias("a_median"), F.mode("v", deterministic=True).alias("a_mode"), F.lit(99999).cast("bigint").alias("other"))
    out = None
    for kind in told.columns:
        truth = s.join(F.broadcast(told.select(F.col(kind).alias("fill")))).select(ROW, F.when(F.col("hole"), F.col("fill")).otherwise(F.col("x")).alias("v"))
        one = J.inferred_strategy(dirty, truth, "v").select(F.lit(kind).alias("kind"), "n_holes", "strategy", "value")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("resolve_by_keys", f"""WITH {D5}, h AS (SELECT o_custkey, status FROM d1 WHERE price IS NULL), t AS (SELECT t.price FROM h JOIN truth t ON h.o_custkey = t.o_custkey AND h.status = t.status AND t._row_index % 3 > 0)
  SELECT (SELECT count(*) FROM h) AS n_holes, CASE WHEN (SELECT count(*) FROM t) < 0.5 * (SELECT count(*) FROM h) THEN 'drop_row' ELSE 'fill_value' END AS strategy,
    (SELECT price FROM t WHERE (SELECT count(*) FROM t) >= 0.5 * (SELECT count(*) FROM h) GROUP BY price ORDER BY count(*) DESC, price LIMIT 1) AS value""")
def resolve_by_keys(spark, sf_dir):
    """The same where truth lacks rows, so that they are found by common columns."""
    before, _, truth = d5(spark, sf_dir)
    return J.inferred_strategy(before.drop("odate", "priority"), truth.where(F.col(ROW) % 3 > 0).drop("odate", "priority"), "price")


@R.add("positional_gather", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _pos, c_custkey AS a_id, s_suppkey AS b_id FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) USING (p)")
def positional_gather(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(ROW), F.col("s_suppkey").alias("id"))
    return J.positional(c, s, "full_outer").select("_pos", "a_id", "b_id")


@R.add("sql_asof", """WITH e AS (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> (SELECT min(event_type) FROM events)),
  r AS (SELECT user_id, ts, max(event_id) AS last_id FROM e GROUP BY ALL) SELECT l.event_id, r.last_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def sql_asof(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    first = ev.agg(F.min("event_type").alias("kind"))
    marked = ev.join(F.broadcast(first))
    right = marked.where("event_type = kind").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    left = marked.where("event_type <> kind").select("event_id", "user_id", "ts")
    return J.asof_join(left, right, "ts", ["user_id"], ["last_id"]).select("event_id", "last_id")


@R.add("range_join", "SELECT s_suppkey, band FROM supplier JOIN (SELECT i AS band, i * 2500 - 2500 AS lo, i * 2500 + 1000 AS hi FROM range(6) t(i)) ON s_acctbal >= lo AND s_acctbal < hi")
def range_join(spark, sf_dir):
    bands = spark.range(6).select(F.col("id").alias("band"), (F.col("id") * 2500 - 2500).alias("lo"), (F.col("id") * 2500 + 1000).alias("hi"))
    return J.range_join(table(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 1000).select("s_suppkey", "band")


@R.add("asof_null_keys", """WITH l AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS u, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT CASE WHEN event_id % 7 > 0 THEN user_id END AS u, ts, max(event_id) AS last_id FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
  SELECT l.event_id, r.last_id FROM l ASOF LEFT JOIN r ON l.u = r.u AND l.ts >= r.ts""")
def asof_null_keys(spark, sf_dir):
    """Null keys match nothing."""
    ev, k = table(spark, sf_dir, "events"), F.col("event_id")
    left = ev.where(k % 2 == 0).select("event_id", F.when(k % 5 > 0, F.col("user_id")).alias("u"), "ts")
    right = ev.where(k % 2 == 1).select(F.when(k % 7 > 0, F.col("user_id")).alias("u"), "ts", "event_id").groupBy("u", "ts").agg(F.max("event_id").alias("last_id"))
    return J.asof_join(left, right, "ts", ["u"], ["last_id"]).select("event_id", "last_id")


_SEMI = "SELECT 'semi' AS kind, count(*) AS n FROM customer {left} SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'anti', count(*) FROM customer {left} ANTI JOIN orders ON c_custkey = o_custkey"


@R.add("sql_join_semi_anti", _SEMI.format(left=""))
def sql_join_semi_anti(spark, sf_dir):
    return _console(spark, sf_dir, _SEMI.format(left="LEFT"), "customer", "orders")


_RANK = "SELECT o_orderkey, rank() OVER w AS rk, lag(o_totalprice) OVER w AS prev, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@R.add("sql_window_rank", _RANK)
def sql_window_rank(spark, sf_dir):
    return _console(spark, sf_dir, _RANK, "orders")


_SETS = "(SELECT c_nationkey AS k, 'both' AS s FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT SELECT c_nationkey, 'none' FROM customer)"


@R.add("sql_setops", _SETS)
def sql_setops(spark, sf_dir):
    return _console(spark, sf_dir, _SETS, "customer", "supplier", "nation")


_CUBE = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, {g} AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


@R.add("sql_rollup_cube", _CUBE.format(g="grouping_id(o_orderstatus, o_orderpriority)"))
def sql_rollup_cube(spark, sf_dir):
    return _console(spark, sf_dir, _CUBE.format(g="grouping_id()"), "orders")


@R.add("sql_console", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_console_query(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("clean_data")
    return sql_console.run(spark, "SELECT o_orderstatus, count(*) AS n FROM clean_data GROUP BY 1")


@R.add("ui_filter_sort_page", f"""WITH {D1} SELECT _row_index, priority FROM d1 WHERE status IN ('F', 'O') AND lower(coalesce(priority, '(blanks)')) LIKE '%n%' AND regexp_replace(regexp_replace(priority, '[0-9]', 'D', 'g'), '[a-zA-Z]', 'A', 'g') IN ('A/A', ' AAAAAAA ', 'A-AAAAAA')
  ORDER BY TRY_CAST(regexp_extract(priority, '^\\s*(-?\\d+(\\.\\d+)?)', 1) AS DOUBLE) NULLS LAST, lower(priority), _row_index LIMIT 20 OFFSET 5""")
def ui_filter_sort_page(spark, sf_dir):
    from ..operators.grid import grid_page

    return grid_page(d1(spark, sf_dir), {"status": ["F", "O"]}, search={"priority": "n"}, formats={"priority": ["A/A", " AAAAAAA ", "A-AAAAAA"]}, sort="priority", page=20, skip=5).select(ROW, "priority")


_RUNS = "SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status, o_custkey AS input_rows, o_orderkey % 1000 AS tokens, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 100) / 100.0 END AS f1 FROM orders"


@R.add("batch_rollup", f"""SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total, coalesce(sum(input_rows) FILTER (WHERE status = 'completed'), 0)::BIGINT AS total_rows,
  coalesce(sum(tokens) FILTER (WHERE status = 'completed'), 0)::BIGINT AS total_tokens, round(100 * avg(f1) FILTER (WHERE status = 'completed'), 4) AS mean_f1 FROM ({_RUNS})""")
def batch_rollup(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return report.batch_rollup(sql_console.run(spark, _RUNS)).withColumn("mean_f1", F.round("mean_f1", 4))


@R.add("anti_join_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_rows(spark, sf_dir):
    losers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("loser"))
    return Z.drop_losers(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), losers, "c_custkey")


@R.add("dedup_key_difference", f"WITH {D1} SELECT DISTINCT o_custkey, priority FROM d1 EXCEPT SELECT o_custkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY _row_index) AS rn FROM d1) WHERE rn = 1")
def dedup_key_difference(spark, sf_dir):
    """Keys that a deduplication removed altogether."""
    from ..operators.dedup import dedup_keys
    from .lineage import key_difference

    df = d1(spark, sf_dir)
    return key_difference(df, dedup_keys(df, ["o_custkey"], "keep_first"), ["o_custkey", "priority"])


@R.add("source_latest", f"WITH {D5} SELECT 'versions' AS kind, 'lineage' AS source, count(*) AS n FROM d5a UNION ALL SELECT 'empty version', 'path', count(*) FROM nation UNION ALL SELECT 'no session', 'path', count(*) FROM nation")
def source_latest(spark, sf_dir):
    """Where a run's data is read from: the latest version if it has rows, else the paths that its state names."""
    store, path = _store(spark, sf_dir), f"{sf_dir}/nation.parquet"
    store.append("empty", table(spark, sf_dir, "region").limit(0).withColumn(ROW, F.lit(0).cast("bigint")), "ingest")
    out = None
    for kind, session in (("versions", "s"), ("empty version", "empty"), ("no session", None)):
        df, source = U.latest_source(spark, store, session, {"dataset_path": path})
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(source.split(":")[0] if source.startswith("lineage") else "path").alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("project_reorder", "SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def project_reorder(spark, sf_dir):
    from .lineage import reorder

    return reorder(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus", "missing"])


_LOGS = "SELECT event_id AS seq, ts AS timestamp, event_type AS agent, CAST(user_id % 50 AS STRING) AS message, value AS detail FROM events"


@R.add("log_union_distinct", f"""WITH e AS ({_LOGS.replace('STRING', 'VARCHAR')}), u AS (SELECT *, 0 AS src FROM e WHERE seq % 3 > 0 UNION ALL SELECT * REPLACE (detail + 1 AS detail), 1 FROM e WHERE seq % 2 = 0)
  SELECT timestamp, agent, message, detail FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, agent, message ORDER BY src, seq) AS rn FROM u) WHERE rn = 1""")
def log_union_distinct(spark, sf_dir):
    """Kept and live log entries, once each."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    e = sql_console.run(spark, _LOGS)
    return U.union_logs(e.where("seq % 3 > 0"), e.where("seq % 2 = 0").withColumn("detail", F.col("detail") + 1), "seq").drop("seq")


__all__ = ["ORACLES", "QUERIES"]
