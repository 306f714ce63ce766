"""Deep pages from a directory; profiles that merge, kept with versions."""
import pytest
from pyspark.sql import functions as F

from tidelake.operators import sketches as S
from tidelake.operators.pages import AT, PART, SortedGrid
from tidelake.operators.profile import ROW
from tidelake.plans.lineage import LineageStore


def numbers(spark, n=5000):
    """A third of the rows share one value, some are null."""
    k = F.col("id")
    return spark.range(n, numPartitions=7).select(k.alias(ROW), F.when(k % 11 != 0, F.when(k % 3 == 0, F.lit("7")).otherwise((k * 7919 % 1009).cast("string"))).alias("v"), (k % 5).alias("w"))


@pytest.mark.parametrize("descending", [False, True])
def test_pages_read_few_files(spark, tmp_path, descending):
    df = numbers(spark)
    grid = SortedGrid.build(df, str(tmp_path / "g"), "v", descending, rows_a_part=400)
    rows = [tuple(r) for r in df.collect()]
    value = lambda r: float(r[1]) * (-1 if descending else 1) if r[1] is not None else 0
    order = sorted(rows, key=lambda r: (r[1] is None, value(r), r[0]))
    assert grid.size() == 5000 and grid.directory.count() > 8
    for skip, size in ((0, 10), (1234, 100), (390, 900), (4990, 100), (5000, 10), (6000, 5), (3, 0)):
        assert [tuple(r) for r in grid.page(skip, size).collect()] == order[skip : skip + size]
        assert len(grid.files(skip, size)) <= size // 200 + 2
    some = grid.filtered(F.col("w") == 2)
    kept = [r for r in order if r[2] == 2]
    assert some.size() == len(kept)
    assert [tuple(r) for r in some.page(700, 50).collect()] == kept[700:750]
    assert [tuple(r) for r in some.filtered(F.col("v") == "7").page(20, 30).collect()] == [r for r in kept if r[1] == "7"][20:50]
    again = SortedGrid(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in again.page(2500, 7).collect()] == order[2500:2507] and not {PART, AT} & set(again.page().columns)


def test_an_empty_grid_has_no_pages(spark, tmp_path):
    grid = SortedGrid.build(numbers(spark).limit(0), str(tmp_path / "g"), "v")
    assert grid.size() == 0 and grid.page().collect() == [] and grid.page().columns == [ROW, "v", "w"]


def test_profiles_merge_within_their_bounds(spark):
    df = spark.range(60_000).select(F.col("id").alias(ROW), (F.col("id") * 7919 % 20011).alias("n"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("t"), F.col("id") % 97)).alias("t"), F.lit(None).cast("double").alias("none"),
                                    F.when(F.col("id") % 2 == 0, "often").otherwise(F.col("id").cast("string")).alias("hot"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"))
    parts = [df.where(F.col(ROW) % 3 == i) for i in range(3)]
    whole = S.merged(S.sketched(parts[0]).unionByName(S.sketched(parts[1])).unionByName(S.sketched(parts[2])))
    told = {r["column_name"]: r for r in S.estimated(whole).collect()}
    assert set(told) == {"n", "t", "none", "hot", "d"}
    for c, exact in (("n", 20011), ("t", 97), ("none", 0), ("hot", 30001), ("d", 400)):
        assert told[c]["n_rows"] == 60_000 and abs(told[c]["distinct_estimate"] - exact) <= 0.04 * exact
    assert told["t"]["n_nulls"] == 15_000 and told["none"]["n_nulls"] == 60_000 and told["none"]["null_rate"] == 1
    assert (told["n"]["least"], told["n"]["greatest"]) == ("0", "20010") and (told["d"]["least"], told["d"]["greatest"]) == ("2020-01-01", "2021-02-03")
    assert all(abs(x / 20011 - d) < 0.015 for x, d in zip(told["n"]["deciles"], S.DECILES, strict=True)) and told["none"]["deciles"] is None and told["t"]["deciles"] is None
    top = told["hot"]["frequent"][0]
    assert top["item"] == "often" and abs(top["count"] - 30_000) <= 60_000 * 3.5 / S.ITEMS * 2


def test_profiles_of_versions(spark, tmp_path):
    store = LineageStore(spark, str(tmp_path / "s"), profiles=True)
    first = numbers(spark).select(ROW, F.col("v").cast("double").alias("v"), "w")
    store.append("a", first, "ingest")
    store.append("a", first.fillna({"v": 2000.0}).drop("w").withColumn("x", F.lit("k")), "fill")
    kept = {r["column_name"]: r for r in store.profile_change("a", 1, 2).collect()}
    assert {c: r["state"] for c, r in kept.items()} == {"v": "kept", "w": "removed", "x": "added"}
    assert kept["v"]["rows_delta"] == 0 and kept["v"]["null_rate_delta"] == pytest.approx(-455 / 5000) and 0.05 < kept["v"]["shift"] < 0.12
    both = {r["column_name"]: r for r in S.estimated(store.profile("a", 1, 2)).collect()}
    assert both["v"]["n_rows"] == 10_000 and both["w"]["n_rows"] == 5000 and both["v"]["greatest"] == "2000.0"
    plain = LineageStore(spark, str(tmp_path / "s"))
    plain.append("a", first, "again")
    shift = {r["column_name"]: r["shift"] for r in plain.profile_change("a", 1, 3).collect()}
    assert shift["v"] < 0.02
    with pytest.raises(KeyError):
        store.profile("a", 9)


def test_empty_tables_have_profiles(spark):
    told = {r["column_name"]: r for r in S.estimated(S.merged(S.sketched(numbers(spark).limit(0)))).collect()}
    assert told["v"]["n_rows"] == 0 and told["v"]["distinct_estimate"] == 0 and told["w"]["deciles"] is None and told["v"]["null_rate"] == 0
