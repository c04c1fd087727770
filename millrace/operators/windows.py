"""Window functions. Each partitions by a key, so rows are spread; ranks that a filter bounds are limited before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import register, table


@query("""select o_orderkey, row_number() over w as rn, cast(ntile(4) over w as bigint) as quarter from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""")
def window_row_number_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("""select p_partkey, rank() over w as r, dense_rank() over w as d, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c from part window w as (partition by p_brand order by p_size)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("c"))


@query("""select event_id, lag(event_id) over w as before, lead(event_type, 2, 'none') over w as after, first_value(event_id) over w as first_id, nth_value(event_id, 2) over w as second
from events window w as (partition by user_id order by ts, event_id)""")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_type", 2, "none").over(w).alias("after"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(w).alias("second"))


@query("""with e as (select *, case when event_type = 'purchase' then event_id end as bought from events)
select event_id, max(bought) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_bought from e""")
def window_last_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids rise with time, so the last purchase is also the largest: what the SQL compares with."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, ignorenulls=True).over(w).alias("last_bought"))


@query("""select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 following), 4) as moving from events""")
def window_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("moving"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as recent from events")
def window_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("events",))
    return spark.sql("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as recent from events")


@query("""select s_nationkey, s_suppkey from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) where rn <= 3""")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is taken on the map side first (WindowGroupLimit), so a hot nation sends three rows a task."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, sf_dir, "supplier").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("s_nationkey", "s_suppkey")


@query("""with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, event_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, cast(session as bigint) as session, count(*) as n from s group by user_id, session""")
def window_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.expr("ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes"), 0).otherwise(1)
    marked = table(spark, sf_dir, "events").withColumn("fresh", fresh)
    return marked.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "session").agg(F.count("*").alias("n"))
