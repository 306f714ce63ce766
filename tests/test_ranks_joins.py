"""Quantiles by counting, proven top values, interval and as-of joins, SQL forms and the console's guard, against plain Python."""
import random
from collections import Counter

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.operators import heavy, ranks
from tidelake.operators import joins as J
from tidelake.operators import relational as Q
from tidelake.plans import sql_console


@pytest.mark.parametrize("held", [1, 40, ranks.HELD])
def test_quantiles_equal_the_sorted_ones(spark, held):
    r = random.Random(held)
    rows = [(float(r.choice([1, 1, 2]) if r.random() < 0.5 else r.gauss(0, 1e3)), None if r.random() < 0.1 else r.lognormvariate(0, 9), r.randrange(3), None) for _ in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double")
    cuts = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = ranks.exact_quantiles(df, {c: F.col(c) for c in "abcd"}, cuts, held=held)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, cuts))) for c in "abc"]).first()
    assert [got[c] for c in "abc"] == [list(w) for w in want] and got["d"] is None


def test_a_search_narrows_on_any_side():
    for rank, found, bounds in ((2, None, (None, 5.0, 0, 10)), (10, 5.0, None), (14, None, (5.0, 9.0, 13, 4)), (17, 9.0, None), (30, None, (9.0, None, 19, 81))):
        s = ranks._Search("x", rank, 100)
        s.narrow(5.0, 9.0, 10, 3, 4, 2)
        assert s.found == found and (bounds is None or (s.low, s.high, s.below, s.inside) == bounds)


def test_top_values_are_exact_with_and_without_a_proof(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc") if r.random() < 0.7 else f"z{r.randrange(9000)}", f"u{i}", i % 4 or None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "o bigint, s string, u string, n int")
    proofs = {}
    got = heavy.top_values(df, {c: F.col(c) for c in "sun"}, 3, "o", proofs).collect()
    assert proofs == {"s": True, "u": False, "n": True}
    for at, c in enumerate("sun", 1):
        times, first = Counter(str(x[at]) for x in rows if x[at] is not None), {}
        for x in rows:
            first.setdefault(str(x[at]), x[0])
        want = sorted(times.items(), key=lambda kv: (-kv[1], first[kv[0]]))[:3]
        assert sorted(((x.value, x.n, x.first) for x in got if x.column_name == c), key=lambda x: (-x[1], x[2])) == [(v, n, first[v]) for v, n in want]
    assert heavy.modes(df.where("o < 0"), ["s", "n"], F.col) == {"s": None, "n": None}
    assert heavy.modes(spark.createDataFrame([("b", 9), ("a", 10)], "s string, n int"), ["s", "n"], F.col) == {"s": "a", "n": 9}


@pytest.mark.parametrize("a, b", [(0, 1), (5, 5), (-7, 9), (0, 1 << 40), (-(1 << 40) + 1, 3), (6, 14)])
def test_dyadic_cells_cover_an_interval_once(spark, a, b):
    cells = spark.range(1).select(J.dyadic_cells(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]
    spans = sorted((c["_cell"] << c["_level"], (c["_cell"] + 1) << c["_level"]) for c in cells)
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and max(Counter(c["_level"] for c in cells).values(), default=0) <= 2
    assert (spans[0][0], spans[-1][1]) == (a, b) if a < b else not spans


@pytest.mark.parametrize("width, cell_rows", [(1, 10**6), (7, 100), (0.5, 50)])
def test_points_in_intervals_of_any_width(spark, width, cell_rows):
    r = random.Random(3)
    points = [(i, r.randrange(-500, 500)) for i in range(300)] + [(900 + i, 7) for i in range(300)] + [(1, None)]
    spans = [(i, (a := r.randrange(-500, 500)), a + r.choice([0, 1, 2, 50, 400])) for i in range(60)] + [(999, -(10**12), 10**12), (1000, None, 3)]
    got = J.range_join(spark.createDataFrame(points, "i int, p int"), spark.createDataFrame(spans, "j int, lo bigint, hi bigint"), "p", "lo", "hi", width, cell_rows=cell_rows)
    assert Counter((x.i, x.j) for x in got.collect()) == Counter((i, j) for i, p in points for j, a, b in spans if None not in (p, a) and a <= p < b)


def test_overlaps_with_an_interval_over_all(spark):
    r = random.Random(4)
    make = lambda n: [(i, (a := r.randrange(-50, 500)), a + r.choice([0, 1, 3, 60])) for i in range(n)] + [(500, -1000, 1000)]
    x, y = make(80), make(90)
    got = J.overlap_join(spark.createDataFrame(x, "i int, a bigint, b bigint"), spark.createDataFrame(y, "j int, c bigint, d bigint"), "a", "b", "c", "d")
    assert Counter((g.i, g.j) for g in got.collect()) == Counter((i, j) for i, a, b in x for j, c, d in y if a < b and c < d and a < d and c < b)


@pytest.mark.parametrize("stripe_rows", [10**6, 50, 7])
def test_asof_join_in_stripes(spark, stripe_rows):
    r = random.Random(stripe_rows)
    left = [(r.choice(["x", "x", "x", "y", None]), r.choice([None, *range(300)]), i) for i in range(500)]
    right = {(r.choice(["x", "x", "y", None]), r.randrange(300)): i if i % 5 else None for i in range(250)}
    df = spark.createDataFrame([(*k, v) for k, v in right.items()], "k string, t int, v int")

    def last(k, t):
        seen = [(t2, v) for (k2, t2), v in right.items() if k2 == k and None not in (k, t) and t2 <= t]
        return max(seen, key=lambda x: x[0])[1] if seen else None

    got = J.asof_join(spark.createDataFrame(left, "k string, t int, i int"), df, "t", ["k"], ["v"], stripe_rows=stripe_rows)
    assert got.columns == ["k", "t", "i", "v"] and Counter((x.i, x.v) for x in got.collect()) == Counter((i, last(k, t)) for k, t, i in left)


def test_overlap_summary_without_pairs(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: [(i % 60, (a := r.randrange(-50, 500)), a + r.choice([-2, 0, 1, 3, 60])) for i in range(n)] + [(500, -1000, 1000)]
    x, y = make(80), make(90)
    want = {}
    for i, a, b in x:
        for j, c, d in y:
            if a < b and c < d and a < d and c < b:
                n, first, last = want.get(i, (0, j, j))
                want[i] = n + 1, min(first, j), max(last, j)
    monkeypatch.setattr(J, "range_join", None)  # pairs are never made
    got = J.overlap_summary(spark.createDataFrame(x, "i int, a bigint, b bigint"), spark.createDataFrame(y, "j int, c bigint, d bigint"), "a", "b", "c", "d", "i", "j", cell_rows=7)
    assert {g.i: (g.n, g.first, g.last) for g in got.select("i", "n", "first", "last").collect()} == want
    with pytest.raises(ValueError):
        J.overlap_summary(got.withColumn("n", F.col("n").cast("double")), got, "n", "last", "first", "last", "i", "i")


@pytest.mark.parametrize("stripe_rows", [10**6, 5])
def test_asof_join_searches_shared_times_once(spark, monkeypatch, stripe_rows):
    r = random.Random(6)
    left = [(r.choice(["x", "y", None]), r.choice([None, *range(0, 90, 3)]), i) for i in range(800)]
    right = [("x", t, t) for t in range(5, 80, 2)] + [(None, 3, 1), ("y", None, 2)]
    sizes, whole = [], J.asof_join

    def seen(l, *rest):
        sizes.append(l.count())
        return whole(l, *rest)

    monkeypatch.setattr(J, "asof_join", seen)
    got = J.asof_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int"), "t", ["k"], ["v"], "t", stripe_rows)
    last = lambda k, t: max((u for j, u, _ in right if k == "x" and j == "x" and t is not None and u <= t), default=None)
    assert Counter((x.i, x.k, x.t, x.v) for x in got.collect()) == Counter((i, k, t, last(k, t)) for k, t, i in left)
    assert sizes[0] == 800 and sizes[1] == len({(k, t) for k, t, _ in left if k and t is not None})


def test_sql_forms_on_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 2, None), (1, 2, "c")], "k int, v int, _rank string")
    w = Window.partitionBy("k").orderBy("v", F.asc_nulls_last("_rank"))
    assert sorted(map(str, Q.qualify(df, rank=(F.row_number().over(w), lambda x: x == 1)).collect())) == sorted(map(str, df.where("_rank IN ('a', 'c')").collect()))
    assert {(r.k, r.v) for r in Q.distinct_on(df, ["k"], [Q.descending(F.col("v"))]).collect()} == {(None, 2), (1, 2)}
    lists = spark.createDataFrame([(1, [1, 2], ["x"]), (2, None, []), (3, [], None)], "i int, a array<int>, b array<string>")
    assert [tuple(r) for r in Q.unnest(lists, a=F.col("a"), b=F.col("b")).orderBy("i", "a").collect()] == [(1, 1, "x"), (1, 2, None)]
    with pytest.raises(ValueError):
        Q.exclude(df, ["nope"])


READING = ["SELECT load FROM names", "SELECT `set`, use AS grant FROM names", "WITH a AS (SELECT 1 AS insert) SELECT * FROM a", "FROM names SELECT load", "TABLE names", "VALUES (1)",
           "SELECT 'drop table x; --' AS text", "SHOW TABLES", "DESCRIBE names", "SELECT * EXCEPT (load) FROM names", "SELECT EXISTS (SELECT 1 FROM names) AS e"]
REFUSED = ["INSERT INTO names SELECT 1", "CREATE TABLE x AS SELECT 1", "SET a = 1", "DROP VIEW names", "CACHE TABLE names", "WITH c AS (SELECT 1) INSERT INTO names SELECT * FROM c",
           "FROM names INSERT INTO u SELECT load", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "SELECT * FROM csv.`x`",
           "SELECT (SELECT max(a) FROM json.`/x`) AS m", "WITH a AS (SELECT * FROM orc.`/x`) SELECT * FROM a", "SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT * FROM names WHERE try_reflect('x', 'y') = 1",
           "ADD JAR 'x'", "EXPLAIN SELECT 1", "", "TRUNCATE TABLE names", "ANALYZE TABLE names COMPUTE STATISTICS", "MERGE INTO names USING names AS s ON true WHEN MATCHED THEN DELETE"]


@pytest.mark.parametrize("query", READING)
def test_the_console_runs_what_reads(spark, query):
    spark.createDataFrame([(1, 2, 3)], "load int, set int, use int").createOrReplaceTempView("names")
    sql_console.run(spark, query).collect()


@pytest.mark.parametrize("query", REFUSED)
def test_the_console_refuses_what_does_not_read(spark, query):
    spark.createDataFrame([(1, 2, 3)], "load int, set int, use int").createOrReplaceTempView("names")
    with pytest.raises((sql_console.QueryRefused, ParseException)):
        sql_console.run(spark, query)
