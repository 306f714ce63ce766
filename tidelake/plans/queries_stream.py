"""Streaming and end-to-end queries; the oracles are what the same batch query gives."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import ROW
from ..scratch import scratch_path
from ..streaming import streams as S
from . import autoplan, executor
from .lineage import LineageStore
from .queries_profile import _DATE as DATE_SQL, _TIME as TIME_SQL, _detect as detect_sql
from .views import D1, D3, Registry, d1, d3, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _events(spark, sf_dir):
    """events as a stream over one file."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def _is_folder(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _drain(stream, spark, name):
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@R.add("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    s = S.dedup_stream(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "100000 days").select("user_id", "event_type")
    return _drain(s, spark, "stream-dedup")


@R.add("stream_window_quality", """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, avg((value IS NULL)::INT) AS value_null_rate, count(*) FILTER (WHERE lower(trim(props)) IN ('n/a', 'null', 'unknown', '-', 'none', '0')) AS props_disguised
  FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_window_quality(spark, sf_dir):
    s = S.window_quality(_events(spark, sf_dir), "ts", ["value", "props"], "1 day", late="1 hour", by=["event_type"])
    return _drain(s.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value_null_rate", "props_disguised"), spark, "stream-window")


@R.add("stream_ingest", "SELECT count(*) AS rows, count(DISTINCT event_id) AS ids FROM events")
def stream_ingest(spark, sf_dir):
    root = scratch_path(spark, "stream-ingest")
    store = LineageStore(spark, root)
    path = f"{sf_dir}/events.parquet"
    q = S.ingest_stream(spark, path if _is_folder(spark, path) else f"{path}*", table(spark, sf_dir, "events").schema, store, "s", f"{root}/state")
    q.awaitTermination()
    return store.read("s").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


@R.add("pipeline_autoplan", f"""WITH {D1}, s AS (SELECT avg(price) AS mean, quantile_cont(price, 0.5) AS median, skewness(price) AS skew, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, min(price) AS lo, max(price) AS hi FROM d1),
  f AS (SELECT CASE WHEN abs(skew) < 1 AND lo >= q1 - 1.5 * (q3 - q1) AND hi <= q3 + 1.5 * (q3 - q1) THEN mean ELSE median END AS fill FROM s), c AS (SELECT d1.*, coalesce(price, fill) AS filled FROM d1, f)
  SELECT count(*) AS rows, (SELECT count(*) FROM d1 WHERE odate IS NULL AND (SELECT count(odate) FROM d1) = 0) AS null_dates, count(*) - count(filled) AS null_prices, round(sum(filled) / count(*), 2) AS mean_price FROM c""")
def pipeline_autoplan(spark, sf_dir):
    """Profile, plan by rules, run and check on the dirty orders."""
    df = d1(spark, sf_dir).withColumn("okey", F.col(ROW))
    store = LineageStore(spark, scratch_path(spark, "autoplan"))
    specs = autoplan.infer_specs(df)
    out = executor.run(autoplan.plan(df, specs), df, store, "s", specs).df
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("odate").isNull()).alias("null_dates"), F.count_if(F.col("price").isNull()).alias("null_prices"), F.round(F.sum("price") / F.count(F.lit(1)), 2).alias("mean_price"))


def _inferred(c):
    share = lambda rx: f"avg(regexp_full_match(trim({c}), '{rx}')::INT)"
    dated, timed = f"regexp_matches({c}, '{DATE_SQL}')", f"regexp_matches({c}, '{TIME_SQL}')"
    return (f"SELECT '{c}' AS column_name, CASE pattern WHEN 'boolean_str' THEN 'bool' WHEN 'date_iso' THEN 'date' WHEN 'datetime_iso' THEN 'datetime' ELSE CASE WHEN both_ + only_ > 0.5 * present THEN CASE WHEN both_ >= only_ THEN 'datetime' ELSE 'time' END "
            f"WHEN ints > 0.8 THEN 'int' WHEN nums > 0.8 THEN 'float' ELSE 'str' END END AS expected_type FROM (SELECT * FROM ({detect_sql(c, 'd3')}), (SELECT count(*) FILTER (WHERE {dated} AND {timed}) AS both_, count(*) FILTER (WHERE NOT {dated} AND {timed}) AS only_, "
            f"count({c}) AS present, {share('[-+]?[0-9]+')} AS ints, {share('[-+]?[0-9]*[.]?[0-9]+')} AS nums FROM d3))")


@R.add("infer_specs", f"WITH {D3} " + " UNION ALL ".join(map(_inferred, ("num", "flag", "stamp", "clock"))))
def infer_specs(spark, sf_dir):
    specs = autoplan.infer_specs(d3(spark, sf_dir))
    return spark.createDataFrame([(c, s.expected_type) for c, s in specs.items()], "column_name string, expected_type string")
