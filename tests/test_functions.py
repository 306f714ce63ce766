"""Functions and operators against plain Python on small tables."""
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelake.functions import dates as D
from tidelake.functions import text as X
from tidelake.operators import cast as C
from tidelake.operators import dedup as E
from tidelake.operators import diff as A
from tidelake.operators import fuzzy as Z
from tidelake.operators import impute as I
from tidelake.operators import joins as J
from tidelake.operators import rules as V
from tidelake.operators.profile import ROW


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_text_folding(spark):
    values = ["Straße  ÉCOLE!", None, "nan", "ＡＢＣ１", "naïve café", "a-b_c", "", "日本 語"]
    assert column(spark, values, X.normal_text) == ["strasse ecole", "", "", "abc1", "naive cafe", "a b c", "", "日本 語"]


def test_phone(spark):
    values = ["(0123) 456-789 ext 12", "0044 20 7946 0100", "12", None, "nan", "+1 555 123 4567x9"]
    assert column(spark, values, X.phone) == ["0123456789", "442079460100", None, None, None, "15551234567"]


def test_shingles(spark):
    assert column(spark, ["abcd", "ab", ""], lambda c: X.shingles(c, 3)) == [["abc", "bcd"], ["ab"], []]
    assert column(spark, ["1 main st", "main"], lambda c: X.shingles(c, 2, "address")) == [["1 main", "main st"], ["ma", "ai", "in"]]


def test_number_token(spark):
    assert column(spark, ["5-6", "1e5", "2.", "abc", "$1,234.50", "-.5"], X.number_token) == ["5", "1", "2", None, "1234.50", "-.5"]


def test_typo_ratio(spark):
    df = spark.createDataFrame([("hospital", "hxspxtxl")], "a string, b string")
    assert df.select(X.typo_ratio("a", "b")).first()[0] == pytest.approx(SequenceMatcher(None, "hospital", "hxspxtxl").ratio())


def test_cross_script(spark):
    df = spark.createDataFrame([("abc", "абв"), ("abc", "def")], "a string, b string")
    assert [r[0] for r in df.select(X.is_cross_script(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_times(spark):
    assert column(spark, ["08:30", "17:45:15", "5:07 pm", "12:00 AM", "25:00", None, "2024-01-02 03:04:05"], D.parse_time) == [
        "08:30:00", "17:45:15", "17:07:00", "00:00:00", None, None, "03:04:05"]
    assert column(spark, ["8h30", "07:25", "8:00 p.m.", "x"], D.clock) == ["08:30", "07:25", "20:00", None]


def test_formats():
    assert D.format_of("2024-05-06") == "%Y-%m-%d" and D.format_of("31/12/2024") == "%d/%m/%Y" and D.format_of("x") is None
    assert D.iso_answer("fill_value: 05/06/2024") == "2024-06-05"
    assert X.regex_of("AB-12.x") == r"^[a-zA-Z]+\-\d{2}\.[a-zA-Z]+$"


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, None), ("b", 1, "z")], "k string, t int, v string")
    assert sorted((r.k, r.t, r.v) for r in J.asof_join(left, right, "t", ["k"], ["v"]).collect()) == [("a", 1, None), ("a", 5, None), ("b", 9, "z")]


def test_positions_are_dense(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", ROW).repartition(5)
    assert [r[0] for r in J.with_position(df).orderBy(ROW).select("_pos").collect()] == list(range(143))


def test_cast_keeps_rows_and_counts_losses(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "2.5"), (2, "x"), (3, None)], f"{ROW} bigint, v string")
    out = C.cast_columns(df, {"v": "int", "nope": "int"})
    assert [r.v for r in out.orderBy(ROW).collect()] == [2, 2, None, None]
    assert C.cast_report(df, out, ["v"]).first().coerced_nulls == 1
    assert C.guard(df, out, {"v": "int", "nope": "int"}) == ["missing_column:nope"]


def test_imputation_order(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, "a"), (2, 9.0, "a")], f"{ROW} bigint, x double, y string")
    r = I.apply_plan(df, {"y": "drop_row", "x": "fill_mean", "z": "fill_mode"})
    assert [(v[ROW], v.x) for v in r.df.orderBy(ROW).collect()] == [(1, 9.0), (2, 9.0)]
    assert r.notes == {"z": "missing column"}
    with pytest.raises(I.FillTypeError):
        I.apply_plan(df, {"x": {"strategy": "fill_value", "fill_value": "abc"}})
    empty = df.withColumn("x", F.lit(None).cast("double"))
    assert "x" in I.apply_plan(empty, {"x": "fill_median"}).notes


def test_dedup_is_idempotent_and_partition_free(spark):
    rows = [(i, i % 7, None if i % 3 else "v") for i in range(100)]
    df = spark.createDataFrame(rows, f"{ROW} bigint, k int, v string")
    once = E.dedup_keys(df, ["k"]).orderBy(ROW).collect()
    assert once == E.dedup_keys(df.repartition(8), ["k"]).orderBy(ROW).collect()
    assert once == E.dedup_keys(E.dedup_keys(df, ["k"]), ["k"]).orderBy(ROW).collect()
    assert E.guard(df, E.dedup_keys(df, ["k"]), E.DedupDecision(["k"])) == []


def replay(pairs, nulls):
    gone = set()
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(a if nulls[a] > nulls[b] else b)
    return gone


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=15))
def test_fuzzy_merge(spark, pairs):
    nulls = {i: i % 2 for i in range(13)}
    df = spark.createDataFrame([(i, None if nulls[i] else "x") for i in range(13)], f"{ROW} bigint, v string")
    links = spark.createDataFrame(sorted(pairs), "row_a bigint, row_b bigint")
    assert {r[0] for r in Z.fuzzy_merge(df, links).select(ROW).collect()} == set(range(13)) - replay(pairs, nulls)


def test_scores(spark):
    t = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], f"{ROW} bigint, s string, n int")
    same = A.score(t, t, t).first()
    assert (same.precision, same.recall, same.cell_accuracy) == (1.0, 1.0, 1.0)
    dirty = t.withColumn("s", F.when(F.col(ROW) == 0, "zz").otherwise(F.col("s")))
    fixed = A.score(dirty, t, t).first()
    assert (fixed.tp, fixed.fp, fixed.fn, fixed.f1) == (1, 0, 0, 1.0)


def test_compare_preview_counts_cells(spark):
    from datetime import datetime

    kind = f"{ROW} bigint, integer bigint, float double, boolean boolean, timestamp timestamp_ntz, missing string, array array<bigint>, nested struct<count:bigint>"
    a = spark.createDataFrame([(0, 1, 1.25, True, datetime(2026, 7, 25, 10, 30), None, [1, 2], (3,))], kind)
    b = spark.createDataFrame([(0, 2, 2.5, False, datetime(2026, 7, 26, 10, 30), None, [2, 3], (4,))], kind)
    cells = A.changed_cells(a, b).collect()
    assert len(cells) == 6 and "missing" not in {c.column_name for c in cells}


def test_rules_on_an_empty_table(spark):
    df = spark.createDataFrame([], f"{ROW} bigint, v string")
    out = V.validate(df, [{"rule": "no_duplicate_rows"}, {"rule": "column_unique", "column": "v"}, {"rule": "null_rate_lt", "column": "v", "threshold": 0.1}, {"rule": "odd"}]).collect()
    assert all(r.passed for r in out) and out[-1].note == "unsupported"


def test_weighted_jaccard_matches_counters(spark):
    from collections import Counter

    a, b = ["x", "x", "y"], ["x", "y", "y", "z"]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    ca, cb = Counter(a), Counter(b)
    want = sum((ca & cb).values()) / sum((ca | cb).values())
    assert df.select(X.weighted_jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)
    assert pd.notna(want)
