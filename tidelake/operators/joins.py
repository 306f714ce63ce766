"""Positional, as-of and ground-truth joins."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .heavy import modes
from .profile import ROW, q
from .ranks import exact_quantiles


#: Stripes in which rows are numbered: FANOUT * FANOUT.
FANOUT = 64


def with_position(df: DataFrame, order: str = ROW, name: str = "_pos") -> DataFrame:
    """Dense positions from 0 in the order of a whole-number column, without gathering rows in one task.

    Rows are numbered inside stripes and shifted by the rows of the stripes before. Stripes have equal width where ids fill a
    quarter of their range, as row indexes do; else they are cut at quantiles, so gaps in the ids don't crowd rows. The stripe is an
    expression of the row, so counting and numbering agree whatever the partitioning."""
    stripe = stripe_of(df, order)
    if stripe is None:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    placed = df.withColumn("_stripe", stripe)
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_stripe").orderBy(order)))
    return shifted(local, placed, "_stripe", "_local", name, first=1)


def stripe_of(df: DataFrame, order: str, rows: int = 1) -> Column | None:
    """The stripe of a row by its whole number, in the order of these; None without any. Stripes of fewer than `rows` rows are put together, about."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if low is None:
        return None
    stripe = _even(F.col(order), low, high) if high - low < 4 * n else _cut(df, order)
    return F.floor(stripe / max(1, FANOUT * FANOUT * rows // n)).cast("int")


def _even(c: Column, low: int, high: int) -> Column:
    width = (high - low) // (FANOUT * FANOUT) + 1
    return F.floor((c - F.lit(low)) / F.lit(width)).cast("int")


def _cut(df: DataFrame, order: str) -> Column:
    """The stripe by approximate quantiles, found in two steps of FANOUT bounds each."""
    n = FANOUT * FANOUT
    at = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], n * 4)).first()[0]
    passed = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col(order)))
    coarse = passed(F.array(*map(F.lit, at[FANOUT - 1 :: FANOUT])))
    fine = F.array(*(F.array(*map(F.lit, at[i * FANOUT : (i + 1) * FANOUT - 1])) for i in range(FANOUT)))
    return (coarse * FANOUT + passed(F.get(fine, coarse))).cast("int")


def shifted(local: DataFrame, counted: DataFrame, group: str, number: str, name: str, first: int) -> DataFrame:
    """local numbers (from `first`) in groups made numbers over all groups, in the groups' order. There are few groups."""
    sums = counted.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return local.join(shifts, F.col(group) == F.col("_g")).withColumn(name, (F.col(number) - first + F.col("_shift")).cast("bigint")).drop(group, number, "_g", "_shift")


def positional(left: DataFrame, right: DataFrame, how: str = "inner", order: str = ROW) -> DataFrame:
    """Row i with row i: columns a_<name> and b_<name>, and _pos. full_outer pads the shorter side with nulls."""
    l, r = with_position(left, order), with_position(right, order)
    l = l.select("_pos", *[q(c).alias(f"a_{c}") for c in left.columns])
    r = r.select("_pos", *[q(c).alias(f"b_{c}") for c in right.columns])
    return l.join(r, "_pos", how)


def aligned(left: DataFrame, right: DataFrame, how: str = "inner", order: str = ROW, align: str = "position") -> DataFrame:
    """positional, or by equal row ids (align = "row_index"), which survives dropped rows."""
    if align == "position":
        return positional(left, right, how, order)
    l = left.select(F.col(order).alias("_pos"), *[q(c).alias(f"a_{c}") for c in left.columns])
    r = right.select(F.col(order).alias("_pos"), *[q(c).alias(f"b_{c}") for c in right.columns])
    return l.join(r, "_pos", how)


def placed(df: DataFrame, order: str = ROW, align: str = "position") -> DataFrame:
    """df with _pos as `aligned` gives it: the dense position, or the row id."""
    return with_position(df, order) if align == "position" else df.withColumn("_pos", F.col(order))


#: Rows of one key that a task carries a value through, about; keys with more are cut into stripes of time.
STRIPE_ROWS, MOST_STRIPES = 1_000_000, 1000
#: Left rows of one key and time, on average, from which each different one is searched once.
SHARED = 4
#: Bounds of stripes that are looked through at a time.
SECTION = 32


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], right_on: str | None = None, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """left with the values of the last right row of the same keys at or before its `on`; a null key or `on` matches nothing.

    Both sides are put in order of time within a key, without pairs. A key of more than stripe_rows rows is cut into stripes of time at its own
    quantiles; the last value of each stripe (one row) is carried on to the stripes after it. So no task has more than a stripe of a key.
    What is found depends on the keys and the time only: where many left rows share these, each different one is searched once."""
    right_on = right_on or on
    moment = F.xxhash64(*by, on)  # of rows with equal ones there are at least so many; collisions change the cost only
    n, apart = left.agg(F.count(F.lit(1)), F.approx_count_distinct(moment)).first()
    if n > SHARED * max(1, apart):
        once = left.select(*by, F.col(on).alias("_on")).dropna().distinct()
        found = asof_join(once, right.withColumnRenamed(right_on, "_right_on"), "_on", by, values, "_right_on", stripe_rows)
        rest = [q(c) for c in left.columns if c not in values]
        named = found.select(*[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], "_on", *[F.col(v).alias(f"_got_{v}") for v in values])
        same = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"_by_{i}") for i, b in enumerate(by)], F.col(on) == F.col("_on"))
        return left.join(named, same, "left").select(*rest, *[F.col(f"_got_{v}").alias(v) for v in values])
    l = left.withColumns({"_t": F.col(on), "_side": F.lit(1)} | {f"_v_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values})
    r = right.select(*[F.col(b) for b in by], F.col(right_on).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_v_{v}") for v in values])
    lacking = F.lit(False)
    for c in [*by, "_t"]:
        lacking = lacking | F.col(c).isNull()
    alone = l.where(lacking)  # rows that can match nothing
    both = l.where(~lacking).unionByName(r.dropna(subset=[*by, "_t"]), allowMissingColumns=True)

    n = F.least(F.ceil(F.col("_n") / stripe_rows), F.lit(MOST_STRIPES)).cast("int")
    large = both.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stripe_rows).select(*by, n.alias("_stripes"))
    last = F.when(F.col("_side") == 0, F.struct(*[f"_v_{v}" for v in values]))
    named = [q(c) for c in left.columns if c not in values], [F.col("_got")[f"_v_{v}"].alias(v) for v in values]
    if large.isEmpty():
        w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_got", F.last(last, ignorenulls=True).over(w)).where("_side = 1")
        return found.unionByName(alone, allowMissingColumns=True).select(*named[0], *named[1])
    keys = [F.col(b) for b in by]
    shares = [i / MOST_STRIPES for i in range(1, MOST_STRIPES)]
    cut = both.join(large, by).groupBy(*by).agg(F.percentile_approx("_t", shares, MOST_STRIPES).alias("_at"), F.first("_stripes").alias("_k"))
    # of a thousand quantiles, as many evenly spaced ones as the key has stripes less one
    bounds = cut.select(*keys, F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.get("_at", F.floor(i * MOST_STRIPES / F.col("_k")).cast("int") - 1)).alias("_bounds"))
    bounds = written(bounds, "asof-bounds")
    # bounds in sections of SECTION: those whose first bound is before the time, then the bounds of the last such section
    sections = F.transform(F.sequence(F.lit(0), F.floor((F.size("_bounds") - 1) / SECTION).cast("int")), lambda i: F.slice("_bounds", i * SECTION + 1, F.lit(SECTION)))
    cut = bounds.withColumn("_sections", F.when(F.size("_bounds") > 0, sections)).withColumn("_firsts", F.transform("_sections", lambda x: x[0])).drop("_bounds")
    before_t = lambda x: x < F.col("_t")
    passed = F.size(F.filter("_firsts", before_t))
    place = F.when(passed > 0, (passed - 1) * SECTION + F.size(F.filter(F.get("_sections", passed - 1), before_t))).otherwise(0)
    dealt = both.join(cut, by, "left").withColumn("_stripe", F.coalesce(place, F.lit(0)).cast("int")).drop("_sections", "_firsts")
    near = Window.partitionBy(*by, "_stripe").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_near", F.last(last, ignorenulls=True).over(near))
    ends = dealt.where("_side = 0").join(bounds.select(*by), by, "left_semi").groupBy(*by, "_stripe").agg(F.max_by(F.struct(*[f"_v_{v}" for v in values]), F.col("_t")).alias("_end"))
    # stripes without right rows are in the frame of those before them
    steps = bounds.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_bounds"))).alias("_stripe")).join(ends, [*by, "_stripe"], "left")
    before = Window.partitionBy(*by).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = seen.where("_side = 1").join(carried, [*by, "_stripe"], "left").withColumn("_got", F.coalesce("_near", "_far"))
    return found.unionByName(alone, allowMissingColumns=True).select(*named[0], *named[1])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float = 1, by: list[str] | None = None, cell_rows: int = 200_000) -> DataFrame:
    """left points inside right intervals [low, high), whatever the intervals' widths.

    Values are counted in units of `width` (which changes the cost only). An interval is the union of dyadic cells, two of each size at most, so a
    wide interval is a few dozen rows; a point stands in one cell of each size that occurs. Cells of more than cell_rows points are
    dealt to several tasks, to each of which their intervals go."""
    unit = lambda c: F.floor(F.col(c) / width).cast("bigint")
    r = right.where(F.col(low) < F.col(high)).withColumn("_cells", dyadic_cells(unit(low), unit(high) + 1))
    r = r.select(*right.columns, F.inline("_cells"))
    sizes = [x[0] for x in r.select("_level").distinct().collect()]  # 63 at most
    l = left.where(F.col(point).isNotNull()).withColumn("_unit", unit(point))
    l = l.withColumn("_level", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_cell", F.expr("shiftright(_unit, _level)")).drop("_unit")
    keys = [*(by or []), "_level", "_cell"]
    met = parted_join(l, r, keys, cell_rows)
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_cell")


def parted_join(l: DataFrame, r: DataFrame, keys: list[str], cell_rows: int) -> DataFrame:
    """l and r of equal keys; keys of more than cell_rows left rows are dealt to several tasks, to each of which their right rows go."""
    crowded = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell_rows).select(*keys, F.ceil(F.col("_n") / cell_rows).cast("int").alias("_parts"))
    crowded = written(crowded, "crowded-cells")
    parts = F.coalesce("_parts", F.lit(1))
    l = l.join(crowded, keys, "left").withColumn("_part", F.floor(F.rand(11) * parts).cast("int")).drop("_parts")
    r = r.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return l.join(r, [*keys, "_part"]).drop("_part")


def dyadic_cells(a: Column, b: Column) -> Column:
    """Array of (_level, _cell): the cells [cell * 2**level, (cell + 1) * 2**level) whose disjoint union is [a, b), two of a level at most."""
    def of(level: Column) -> Column:
        low = -F.call_function("shiftright", -a, level)  # upwards
        high = F.call_function("shiftright", b, level)
        left = F.when((F.abs(low % 2) == 1) & (low < high), low)
        start = low + F.abs(low % 2)
        right = F.when((F.abs(high % 2) == 1) & (high - 1 >= start) & (low < high), high - 1)
        return F.array(F.struct(level.alias("_level"), left.alias("_cell")), F.struct(level.alias("_level"), right.alias("_cell")))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), of))
    return F.filter(every, lambda x: x["_cell"].isNotNull())


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, right_low: str, right_high: str, width: float = 1, by: list[str] | None = None) -> DataFrame:
    """Pairs of left intervals [low, high) and right ones that share a point: either the right one starts inside the left one, or the left one starts
    inside the right one and later."""
    l, r = left.where(F.col(low) < F.col(high)), right.where(F.col(right_low) < F.col(right_high))
    starts = range_join(r, l, right_low, low, high, width, by)
    inside = range_join(l, r, low, right_low, right_high, width, by).where(F.col(low) > F.col(right_low))
    return starts.select(*inside.columns).unionByName(inside)


def overlap_summary(left: DataFrame, right: DataFrame, low: str, high: str, right_low: str, right_high: str, key: str, value: str, cell_rows: int = 200_000) -> DataFrame:
    """(key, n, first, last): of the pairs of left intervals [low, high) and right ones that share a point, their number and the least and greatest value
    of the right ones, for each key of the left ones. Bounds are whole numbers. Keys without a pair are left out.

    Pairs aren't made. Right starts are summed up by dyadic cell, and a left interval reads its few dozen cells; right intervals (without their starts)
    are summed up by each of their cells, and a left start reads the cell of each size that it stands in. So each side is taken times the sizes of cells."""
    for df, c in ((left, low), (left, high), (right, right_low), (right, right_high)):
        if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long"):
            raise ValueError(f"{c} isn't of whole numbers")
    merged = lambda n, first, last: [F.sum(n).alias("n"), F.min(first).alias("first"), F.max(last).alias("last")]
    l = left.where(F.col(low) < F.col(high)).groupBy(q(key).alias("_key"), F.col(low).cast("bigint").alias("_low"), F.col(high).cast("bigint").alias("_high")).agg(F.count(F.lit(1)).alias("_times"))
    r = right.where(F.col(right_low) < F.col(right_high)).groupBy(F.col(right_low).cast("bigint").alias("_from"), F.col(right_high).cast("bigint").alias("_to"))
    r = written(r.agg(F.count(F.lit(1)).alias("n"), F.min(q(value)).alias("first"), F.max(q(value)).alias("last")), "intervals")
    l = written(l, "intervals")

    def at(df: DataFrame, point: str, cells: DataFrame) -> DataFrame:
        """df in the cell of each size that cells has."""
        sizes = [x[0] for x in cells.select("_level").distinct().collect()]  # 63 at most
        return df.withColumn("_level", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))).withColumn("_cell", F.expr(f"shiftright({point}, _level)"))

    def celled(df: DataFrame, a: Column, b: Column) -> DataFrame:
        return df.where(a < b).select("*", F.inline(dyadic_cells(a, b)))

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("_level", "_cell").agg(*merged("n", "first", "last"))

    spans = celled(l, F.col("_low"), F.col("_high")).select("_key", "_times", "_level", "_cell")
    starts = at(r.groupBy("_from").agg(*merged("n", "first", "last")), "_from", spans)
    inside = celled(r, F.col("_from") + 1, F.col("_to"))
    points = at(l, "_low", inside).select("_key", "_times", "_level", "_cell")
    met = [parted_join(asks, summed(cells), ["_level", "_cell"], cell_rows).select("_key", (F.col("n") * F.col("_times")).alias("n"), "first", "last") for asks, cells in ((spans, starts), (points, inside))]
    return met[0].unionByName(met[1]).groupBy(F.col("_key").alias(key)).agg(*merged("n", "first", "last"))


def truth_for_nulls(dirty: DataFrame, truth: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Ground-truth values of the rows whose `column` is null, joined on keys that are never null."""
    holes = dirty.where(q(column).isNull()).select(*[q(k) for k in keys])
    return holes.join(truth.select(*[q(k) for k in keys], q(column)), keys)


def join_keys(dirty: DataFrame, truth: DataFrame, most: int = 3) -> list[str]:
    """The first common columns without nulls on either side."""
    common = [c for c in dirty.columns if c in truth.columns and c != ROW]
    nulls = lambda df: df.agg(*[F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(common)]).first()
    a, b = nulls(dirty), nulls(truth)
    return [c for i, c in enumerate(common) if not a[i] and not b[i]][:most]


FILLS = ("fill_mean", "fill_median", "fill_mode", "fill_value")


def inferred_strategy(dirty: DataFrame, truth: DataFrame, column: str, options: tuple[str, ...] = FILLS, order: str = ROW) -> DataFrame:
    """One row: n_holes, strategy and value that explain the truth of a column's holes.

    Tables of equal length are laid side by side; else the holes' rows are found by up to three common columns without nulls. value is the most
    frequent truth (of equals the least). It is called the mean or the median if it is near it (a thousandth, or equal once that is rounded to a
    whole number), the mode if it is that; else a constant. Without truth the holes stay; rows that truth lacks are dropped."""
    name = q(column)
    holes = dirty.where(name.isNull()).count()
    same, keys = dirty.count() == truth.count(), []
    if same:
        both = positional(dirty.select(order, name), truth.select(order, name), order=order)
        found = both.where(q(f"a_{column}").isNull()).select(q(f"b_{column}").alias("t"))
    else:
        keys = join_keys(dirty, truth)
        found = truth_for_nulls(dirty, truth, column, keys).select(name.alias("t")) if keys else truth.select(name.alias("t")).limit(0)
    most = lambda df, c: F.lit(modes(df, [c], q)[c]).cast(df.schema[c].dataType)
    t = found.agg(F.count(F.lit(1)).alias("found"), F.count("t").alias("told")).withColumn("value", most(found, "t"))
    number = dirty.select(name.try_cast("double").alias("x"), name.alias("v"))
    median = exact_quantiles(number, {"x": F.col("x")}, [0.5])["x"]
    s = number.agg(F.avg("x").alias("mean")).withColumns({"median": F.lit(median and median[0]).cast("double"), "mode": most(number, "v")})
    v = F.col("value").try_cast("double")

    def near(c: str) -> Column:
        close = F.abs(v - F.col(c)) <= 1e-3 * F.greatest(F.abs(v), F.abs(F.col(c)))
        return F.coalesce(close | (F.bround(F.col(c), 0) == F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))), F.lit(False))

    explained = F.lit("fill_value")
    for kind, fits in (("fill_mode", F.col("value").cast("string") == F.col("mode").cast("string")), ("fill_median", near("median")), ("fill_mean", near("mean"))):
        if kind in options:
            explained = F.when(F.coalesce(fits, F.lit(False)), kind).otherwise(explained)
    if not same:  # rows were matched by keys, so only a constant can be told
        explained = F.lit("fill_value")
    lost = F.lit(not same) & ((F.col("found") < 0.5 * holes) | F.lit(not keys))
    strategy = F.when(F.lit(holes == 0), "leave_as_is").when(lost, "drop_row").when(F.col("told") == 0, "leave_as_is").otherwise(explained)
    return t.join(F.broadcast(s)).select(F.lit(holes).cast("bigint").alias("n_holes"), strategy.alias("strategy"), F.when(strategy.isin(*FILLS), F.col("value")).alias("value"))
