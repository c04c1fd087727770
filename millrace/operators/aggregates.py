"""Aggregates. All but distinct sets combine on the map side before they shuffle; exact percentiles are selected (`selection`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.operators.selection import exact_percentiles
from millrace.session import register, table, tables


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc,
round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(disc), 4).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("select event_type, min(value) as low, max(value) as high, min(user_id) as first_user, max(props) as last_props from events group by event_type")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("user_id").alias("first_user"), F.max("props").alias("last_props"))


@query("select l_returnflag, count(distinct l_orderkey) as orders, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""select o_orderpriority, round(stddev_samp(o_totalprice), 4) as sd, round(var_pop(o_totalprice), 2) as vp, round(median(o_totalprice), 4) as med,
round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by o_orderpriority""")
def agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread by partial sums, exact percentiles by selection: no task holds a group, however few there are."""
    price, orders = F.col("o_totalprice"), table(spark, sf_dir, "orders")
    spread = orders.groupBy("o_orderpriority").agg(F.round(F.stddev(price), 4).alias("sd"), F.round(F.var_pop(price), 2).alias("vp"))
    ranked = exact_percentiles(orders, "o_orderpriority", "o_totalprice", {"med": 0.5, "p90": 0.9}).select("o_orderpriority", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"))
    return spread.join(ranked, "o_orderpriority")


@query("select round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_pop(l_discount, l_tax), 8) as cov from lineitem")
def agg_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_pop("l_discount", "l_tax"), 8).alias("cov"))


_LEVELS = "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as bigint) as g1, cast(grouping(l_linestatus) as bigint) as g2 from lineitem group by "


@query(_LEVELS + "grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("lineitem",))
    return spark.sql(_LEVELS + "grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")


def _levels(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"))


@query(_LEVELS + "rollup (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_LEVELS + "cube (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("""select l_returnflag, round(sum(case when l_linestatus = 'F' then l_quantity end), 2) as "F", round(sum(case when l_linestatus = 'O' then l_quantity end), 2) as "O" from lineitem group by l_returnflag""")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("select p_brand, bool_or(p_size > 49) as any_large, bool_and(p_size > 0) as all_some, cast(bit_or(p_size) as integer) as bits from part group by p_brand")
def agg_boolean_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 49).alias("any_large"), F.bool_and(F.col("p_size") > 0).alias("all_some"), F.bit_or("p_size").alias("bits"))


@query("select user_id, arg_max(event_id, ts) as last_event, arg_min(event_type, ts) as first_type from events group by user_id")
def agg_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("last_event"), F.min_by("event_type", "ts").alias("first_type"))


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
def agg_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("nation",))
    return spark.sql("select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey")


@query("""with c as (select user_id, event_type, count(*) as n from events group by all),
m as (select user_id, event_type, row_number() over (partition by user_id order by n desc, event_type) as place from c)
select user_id, max(case when place = 1 then event_type end) as most, string_agg(event_type, ',' order by event_type) as kinds from m group by user_id""")
def agg_mode_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent type of each user (the smallest of equally frequent ones), and all of their types."""
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("most"), kinds.alias("kinds"))


@query("select s_nationkey, count(*) filter (where s_acctbal > 0) as positive, round(sum(s_acctbal) filter (where s_acctbal < 0), 2) as debt from supplier group by s_nationkey")
def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("supplier",))
    return spark.sql("select s_nationkey, count(*) filter (where s_acctbal > 0) as positive, round(sum(s_acctbal) filter (where s_acctbal < 0), 2) as debt from supplier group by s_nationkey")


@query("select event_type, quantile_disc(value, 0.5) as middle, count(distinct hour(ts)) as hours, count(distinct hour(ts)) as hours_theta from events group by event_type")
def agg_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates where they are exact: the middle rank is off by at most one in 10,000 rows, sketches hold few values.

    Their errors on many values are held against the exact figures in the tests.
    """
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.percentile_approx("value", 0.5).alias("middle"), F.hll_sketch_estimate(F.hll_sketch_agg(hour)).alias("hours"), F.theta_sketch_estimate(F.theta_sketch_agg(hour)).alias("hours_theta"),
    )


@query("select event_type, count(distinct user_id) as users from events group by event_type")
def agg_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts by bitmaps, one for each bucket of ids: they merge by OR, however the rows are spread."""
    parts = table(spark, sf_dir, "events").groupBy("event_type", F.bitmap_bucket_number("user_id").alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("user_id"))).alias("n"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("users"))


@query("select event_type as item, count(*) as n from events group by event_type")
def agg_top_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """approx_top_k, exact here as the sketch has room for every type."""
    register(spark, sf_dir, ("events",))
    return spark.sql("select t.item, t.count as n from (select explode(approx_top_k(event_type, 5, 100)) as t from events)")


@query("select event_type, count(*) as n, true as within from events group by event_type")
def agg_histogram_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of their own width: together they hold every row, and their centres lie within the values' range."""
    bins = table(spark, sf_dir, "events").groupBy("event_type").agg(F.histogram_numeric("value", F.lit(10)).alias("h"), F.min("value").alias("low"), F.max("value").alias("high"))
    held = F.aggregate("h", F.lit(0.0), lambda a, b: a + b["y"]).cast("long")
    return bins.select("event_type", held.alias("n"), F.forall("h", lambda b: (b["x"] >= F.col("low")) & (b["x"] <= F.col("high"))).alias("within"))


@query("select cast(floor(o_totalprice / 50000) as bigint) as bucket, count(*) as n from orders group by bucket")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bucket")).agg(F.count("*").alias("n"))


@query("""select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-04-01'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by o_orderpriority""")
def agg_order_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    dated = orders.where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1995-04-01'")
    return dated.join(lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
