"""Joins, and those that Spark has no operator for: as-of and range joins.

Sides are not marked for broadcast by hand; Catalyst and AQE broadcast a side whose size they have measured.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import register, table, tables


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], bucket: Callable[[Column], Column] | None = None, hot_rows: int = 0) -> DataFrame:
    """Each left row with `values` of the last right row of the same `by` at or before it; nulls if there is none.

    Both sides are laid in one stream, and the last right row is carried on: one shuffle and sort. `bucket` cuts the stream
    of a key into stretches of time (any function of `at` that never falls as `at` rises), so that a hot key is many
    tasks; what a stretch starts with comes from a table with one row for each key and stretch. With `hot_rows` the rows of each
    key are counted first, and only keys with more are cut; where there is none, nothing else is read twice. Ties among right rows
    are broken by their values, largest last. Rows with a null key match nothing and stay out of the shuffle.
    """
    named, rows = F.struct(F.col(at).alias("at"), *values), F.struct(*left.columns)
    known = lambda df: df.where(F.col(by).isNotNull())
    empty = F.lit(None).cast(right.select(named.alias("v")).schema["v"].dataType)
    no_row = F.lit(None).cast(left.select(rows.alias("r")).schema["r"].dataType)
    part = bucket(F.col(at)) if bucket else F.lit(0)
    if bucket and hot_rows:
        rows_of = known(left).select(by).union(known(right).select(by)).groupBy(by).count()
        hot = [r[0] for r in rows_of.where(F.col("count") > hot_rows).collect()]  # one in `hot_rows` rows at most
        bucket, part = (bucket, F.when(F.col(by).isin(hot), part)) if hot else (None, F.lit(0))
    ours = known(left).select(by, part.alias("__part"), F.lit(2).alias("__side"), F.col(at).alias("__at"), rows.alias("__row"), empty.alias("__value"))
    theirs = known(right).where(F.col(at).isNotNull()).select(by, part.alias("__part"), F.lit(1).alias("__side"), F.col(at).alias("__at"), no_row.alias("__row"), named.alias("__value"))
    stream = ours.unionByName(theirs)
    if bucket:
        ends = stream.groupBy(by, "__part").agg(F.max("__value").alias("__value"))
        before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(by, "__part", F.lit(0).alias("__side"), F.lit(None).cast(left.schema[at].dataType).alias("__at"), no_row.alias("__row"), F.last("__value", ignorenulls=True).over(before).alias("__value"))
        stream = stream.unionByName(carried)
    order = Window.partitionBy(by, "__part").orderBy(F.asc_nulls_first("__at"), "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.withColumn("__last", F.last("__value", ignorenulls=True).over(order)).where("__side = 2")
    unmatched = left.where(F.col(by).isNull()).select(rows.alias("__row"), empty.alias("__last"))
    return seen.select("__row", "__last").union(unmatched).select("__row.*", *(F.col(f"__last.{v}").alias(f"asof_{v}") for v in values))


def dyadic_cover(low: Column, high: Column) -> Column:
    """The whole numbers from low to high as an array of cells (level, cell), each 2^level numbers from cell * 2^level on.

    At most two cells a level, so their number follows the logarithm of the width. Empty where low > high.
    """
    end = high + 1
    levels = F.sequence(F.lit(0), F.greatest(F.length(F.bin(F.greatest(high - low, F.lit(0).cast("long")))), F.lit(1)))

    def at(k: Column) -> Column:
        # The cells of this level that lie within the range are [first, last); those of the next level take whole pairs of them.
        up, down = F.negate(F.call_function("shiftright", F.negate(low), k)), F.call_function("shiftright", end, k)
        left = (up % 2 != 0) & (up < down)
        right = (down % 2 != 0) & (down - 1 >= up + left.cast("long"))
        cell = lambda c: F.struct(k.alias("level"), c.alias("cell"))
        return F.array_compact(F.array(F.when(left, cell(up)), F.when(right, cell(down - 1))))

    return F.flatten(F.transform(levels, at))


def _grid(c: Column, width: float) -> Column:
    """The step of a grid that `c` is in; never falls as `c` rises."""
    most = float(1 << 60)
    return F.floor(F.greatest(F.least(c.cast("double") / F.lit(float(width)), F.lit(most)), F.lit(-most))).cast("long")


def range_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows where low <= point <= high, without a common key, for ranges of any width.

    Numbers go to a grid with steps of `width`. A range is cut into dyadic cells, some two for each doubling of its width; a point is
    in one cell of every level that any range has. A point meets a range in exactly one cell, so no pair comes twice.
    """
    grid = lambda c: _grid(c, width)
    ranged = right.withColumn("__cover", F.explode(F.when(low <= high, dyadic_cover(grid(low), grid(high))))).withColumns({"__level": F.col("__cover.level"), "__cell": F.col("__cover.cell")}).drop("__cover")
    levels = sorted(r[0] for r in ranged.select("__level").distinct().collect())  # 62 at most
    if not levels:
        return left.join(right, F.lit(False))
    cells = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(grid(point), k).alias("cell")) for k in levels))
    points = left.withColumn("__in", F.explode(F.when(point.isNotNull(), cells))).withColumns({"__level": F.col("__in.level"), "__cell": F.col("__in.cell")}).drop("__in")
    return points.join(ranged, ["__level", "__cell"]).where((point >= low) & (point <= high)).drop("__level", "__cell")


def range_parts(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """low, high and the partial aggregates that make up each distinct range: those of whole cells, and of single values at its two ends.

    Steps strictly between those of a range's ends hold no point outside of it. They are covered by dyadic cells, each of which has
    been aggregated once, whatever number of ranges holds it. In the steps of the ends every distinct value is compared.
    """
    merged = [merge(F.col(name)).alias(name) for name, (_, merge) in parts.items()]
    values = points.where(F.col(point).isNotNull()).groupBy(F.col(point).cast("double").alias("__p")).agg(*(made.alias(name) for name, (made, _) in parts.items()))
    values = values.withColumn("__cell", _grid(F.col("__p"), width))
    distinct = ranges.select(F.col(low).cast("double").alias("__low"), F.col(high).cast("double").alias("__high")).where("__low <= __high").distinct()
    first, last = _grid(F.col("__low"), width), _grid(F.col("__high"), width)
    ends = distinct.withColumn("__cell", F.explode(F.array_distinct(F.array(first, last))))
    at_ends = ends.join(values, "__cell").where("__p >= __low and __p <= __high").select("__low", "__high", *parts)
    covers = distinct.withColumn("__cover", F.explode(dyadic_cover(first + 1, last - 1))).select("__low", "__high", F.col("__cover.level").alias("__level"), F.col("__cover.cell").alias("__cell"))
    levels = sorted(r[0] for r in covers.select("__level").distinct().collect())  # 62 at most
    if not levels:
        return at_ends
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("__cell", k).alias("cell")) for k in levels)))
    cells = values.withColumn("__in", each).groupBy(F.col("__in.level").alias("__level"), F.col("__in.cell").alias("__cell")).agg(*merged)
    return at_ends.unionByName(covers.join(cells, ["__level", "__cell"]).select("__low", "__high", *parts))


def range_aggregate(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """`ranges` with aggregates of the points from low to high, without those that hold none; no pair of a point and a range is made.

    `parts` gives for each name an aggregate of points and the function that merges such aggregates, as (F.count("*"), F.sum). Work grows
    with points and ranges, times the levels of the grid, and not with the points in a range. `width` should leave few distinct values
    in a step; point, low and high count as doubles.
    """
    merged = [merge(F.col(name)).alias(name) for name, (_, merge) in parts.items()]
    found = range_parts(points, ranges, point, low, high, width, parts).groupBy("__low", "__high").agg(*merged)
    keyed = ranges.withColumns({"__low": F.col(low).cast("double"), "__high": F.col(high).cast("double")})
    return keyed.join(found, ["__low", "__high"]).drop("__low", "__high")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    return orders.join(customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


_LINES = "select o_orderkey, count(*) as n, round(sum(l_quantity), 2) as quantity from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey"


def _by_strategy(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    joined = lineitem.join(orders.hint(hint), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(_LINES)
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_strategy(spark, sf_dir, "merge")


@query(_LINES)
def join_shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_strategy(spark, sf_dir, "shuffle_hash")


def _outer(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    nation, supplier = tables(spark, sf_dir, "nation", "supplier")
    some = supplier.where("s_nationkey < 12 and s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return nation.where("n_nationkey > 5").join(some, F.col("n_nationkey") == F.col("k"), how).select("n_nationkey", "s_suppkey")


_OUTER = "select n_nationkey, s_suppkey from (select * from nation where n_nationkey > 5) {} join (select s_suppkey, s_nationkey as k from supplier where s_nationkey < 12 and s_acctbal > 0) on n_nationkey = k"


@query(_OUTER.format("left"))
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "left")


@query(_OUTER.format("right"))
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "right")


@query(_OUTER.format("full"))
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "full")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders.join(lineitem.where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


_NOT_IN = """select 'none' as nulls, p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 47)
union all select 'some' as nulls, p_partkey from part where p_partkey not in (select case when l_linenumber > 1 then l_partkey end from lineitem where l_quantity > 47)
union all select 'left' as nulls, k as p_partkey from (select case when p_partkey % 2 = 1 then p_partkey end as k from part) where k not in (select l_partkey from lineitem where l_quantity > 47)"""


@query(_NOT_IN)
def join_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN: a null among the values (`some`) leaves no row, a null on the left is no row either: of `none` only the odd keys are in `left`."""
    register(spark, sf_dir, ("part", "lineitem"))
    return spark.sql(_NOT_IN)


@query("""with a as (select s_suppkey as k, case when s_suppkey % 3 > 0 then s_nationkey end as n from supplier), b as (select n_nationkey as m, case when n_nationkey % 2 > 0 then n_nationkey end as n from nation)
select k, m, a.n is not distinct from b.n as both from a full join b on a.n = b.n""")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys on both sides match nothing, and an outer join keeps their rows."""
    nation, supplier = tables(spark, sf_dir, "nation", "supplier")
    a = supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("a"))
    b = nation.select(F.col("n_nationkey").alias("m"), F.when(F.col("n_nationkey") % 2 > 0, F.col("n_nationkey")).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").select("k", "m", F.col("a").eqNullSafe(F.col("b")).alias("both"))


@query("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of fixed size; there is no key to shuffle on."""
    nation = table(spark, sf_dir, "nation")
    a, b = nation.alias("a"), nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("select r_name, n_name from region cross join nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = tables(spark, sf_dir, "region", "nation")
    return region.crossJoin(nation).select("r_name", "n_name")


@query("""select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase'
and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("at"))
    b = events.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("ts").alias("bt"))
    return a.join(b, "user_id").where("bt >= at and bt <= at + interval 1 hour").select("a", "b")


@query("""with r as (select r_regionkey as k, 900.0 + 150 * r_regionkey as low, 1000.0 + 150 * r_regionkey as high from region)
select p_partkey, k from part join r on p_retailprice >= low and p_retailprice <= high""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, region = tables(spark, sf_dir, "part", "region")
    r = region.select(F.col("r_regionkey").alias("k"), (900.0 + 150 * F.col("r_regionkey")).alias("low"), (1000.0 + 150 * F.col("r_regionkey")).alias("high"))
    return range_join(part, r, F.col("p_retailprice"), F.col("low"), F.col("high"), 100.0).select("p_partkey", "k")


_WIDE = "select s_suppkey as k, 4000.0 * (s_suppkey % 100) as low, 4000.0 * (s_suppkey % 100) + power(10, s_suppkey % 7) as high from supplier"


@query(f"select k, count(*) as n, min(o_orderkey) as first_order, cast(sum(o_orderkey) as bigint) as keys from orders join ({_WIDE}) r on o_totalprice >= low and o_totalprice <= high group by k")
def join_ranges_of_any_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from 1 to 10^6 wide, on a grid of cents; what lies in a range is put together from aggregated cells."""
    register(spark, sf_dir, ("supplier",))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parts = {"n": (F.count("*"), F.sum), "first_order": (F.min("o_orderkey"), F.min), "keys": (F.sum("o_orderkey"), F.sum)}
    met = range_aggregate(orders, spark.sql(_WIDE), "o_totalprice", "low", "high", 0.01, parts)
    return met.groupBy("k").agg(*(merge(name).alias(name) for name, (_, merge) in parts.items()))


@query("""select a.event_id, b.event_id as asof_seen, round(b.value, 4) as asof_value from (select * from events where event_type = 'purchase') a
asof left join (select * from events where event_type = 'view') b on a.user_id = b.user_id and a.ts >= b.ts""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"), "value")
    found = asof_join(left, right, "user_id", "ts", ["seen", "value"], lambda at: at.cast("date"), hot_rows=1_000_000)
    return found.select("event_id", "asof_seen", F.round("asof_value", 4).alias("asof_value"))


@query("""select n_name, s_suppkey from nation, lateral (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 2)""")
def join_lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("nation", "supplier"))
    return spark.sql("select n_name, s_suppkey from nation, lateral (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 2)")
