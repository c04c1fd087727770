"""Running aggregates over keys of any size: a prefix scan in two levels in place of one window a key.

A hot key is cut into stretches of its order column, each a task of its own. Every stretch is summed up in one row; a window
over these few rows says what each stretch starts from; windows within the stretches do the rest. Keys with few rows are
one stretch, so they cost what a plain window costs and a join of the small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table

#: Rows of a key from which on it is cut, about as many to a stretch; the most stretches of a key.
STRETCH_ROWS, MOST_STRETCHES = 250_000, 4096


def with_stretches(df: DataFrame, by: str, at: str, rows: int = STRETCH_ROWS, most: int = MOST_STRETCHES) -> DataFrame:
    """`df` with `__stretch`, a number that never falls as `at` rises within a key; rows that tie stay together.

    Edges are quantiles of a sketch of each hot key, so stretches hold about the same number of rows. There are at most as
    many hot keys as the table has times `rows` rows; their edges join by a broadcast if they are small, as measured.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp")) if dict(df.dtypes)[at].startswith("timestamp") else F.col(at)
    keyed = df.withColumn("__m", micros)
    hot = keyed.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx("__m", [k / 64 for k in range(1, 64)]).alias("coarse"))
    hot = hot.where((F.col("n") > rows) & F.col(by).isNotNull())
    # Up to 64 stretches from one pass; a key that needs more has each of these cut evenly in time.
    parts = F.least(F.lit(most), F.ceil(F.col("n") / rows)).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(64) / parts)).cast("int")
    edges = F.array_distinct(F.filter("coarse", lambda x, i: (i + 1) % step == 0))
    hot = hot.select(F.col(by).alias("__k"), edges.alias("__edges"), F.ceil(parts / 64).cast("int").alias("__finer"))
    cut = keyed.join(hot, F.col(by) == F.col("__k"), "left")
    m, e = F.col("__m"), F.col("__edges")
    band = F.size(F.filter(e, lambda x: x < m))
    low, high = F.get(e, band - 1), F.get(e, band)
    inner = F.when((F.col("__finer") > 1) & low.isNotNull() & high.isNotNull(), F.floor((m - low) * (F.col("__finer") - 1) / F.greatest(high - low, F.lit(1)))).otherwise(0)
    return cut.withColumn("__stretch", F.when(e.isNull() | m.isNull(), F.lit(-1).cast("long")).otherwise(band.cast("long") * most + inner.cast("long"))).drop("__k", "__edges", "__finer", "__m")


def running(df: DataFrame, by: str, order: list[str], sums: dict[str, Column], lasts: dict[str, Column], rows: int = STRETCH_ROWS) -> DataFrame:
    """`df` with running sums (decimals or integers stay exact) and last non-null values, up to and with each row.

    `order` begins with the column that the stretches cut, and should be unique within a key. Nulls of `order` come first.
    """
    cut = with_stretches(df, by, order[0], rows)
    given = cut.select("*", *(c.alias(f"__s_{n}") for n, c in sums.items()), *(c.alias(f"__l_{n}") for n, c in lasts.items()))
    within = Window.partitionBy(by, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    totals = given.groupBy(by, "__stretch").agg(
        *(F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums),
        *(F.max(F.when(F.col(f"__l_{n}").isNotNull(), F.struct(place.alias("at"), F.col(f"__l_{n}").alias("v"))))["v"].alias(f"__l_{n}") for n in lasts),
    )
    before = Window.partitionBy(by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(by).alias("__k"), F.col("__stretch").alias("__t"),
        *(F.sum(f"__s_{n}").over(before).alias(f"__b_{n}") for n in sums), *(F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts),
    )
    joined = given.join(starts, F.col(by).eqNullSafe(F.col("__k")) & (F.col("__stretch") == F.col("__t")))
    own = lambda n: F.sum(f"__s_{n}").over(within)
    added = {n: F.when(own(n).isNull(), F.col(f"__b_{n}")).otherwise(own(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0))) for n in sums}
    carried = {n: F.coalesce(F.last(f"__l_{n}", ignorenulls=True).over(within), F.col(f"__c_{n}")) for n in lasts}
    return joined.select(*df.columns, *(c.alias(n) for n, c in {**added, **carried}.items()))


def sessions(df: DataFrame, by: str, at: str, gap_seconds: int, rows: int = STRETCH_ROWS) -> DataFrame:
    """by, session (from 1), start, end, n: a row at least `gap_seconds` after the one before it in its key starts a session.

    Rows without a key or a time are in no session.
    """
    cut = with_stretches(df.where(F.col(by).isNotNull() & F.col(at).isNotNull()), by, at, rows)
    within = Window.partitionBy(by, "__stretch").orderBy(at)
    gap = F.make_dt_interval(secs=F.lit(gap_seconds).cast("decimal(18,6)"))
    opens = (F.col(at) >= F.lag(at).over(within) + gap).cast("long")  # null where the stretch begins: not known yet
    marked = cut.select(by, "__stretch", at, opens.alias("__opens"))
    # Sessions within each stretch first, numbered from 0: few rows, whatever the key's size.
    local = marked.withColumn("__no", F.sum(F.coalesce("__opens", F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = local.groupBy(by, "__stretch", "__no").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    # A stretch's first session goes on with the last one of the stretch before if the gap between them is short.
    order = Window.partitionBy(by).orderBy("__stretch", "__no")
    new = F.when(F.col("start") < F.lag("end").over(order) + gap, 0).otherwise(1)
    numbered = pieces.withColumn("__new", new).withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


@query("""select event_id, cast(sum(cast(round(value * 100) as bigint)) over w as bigint) as cents, count(*) over w as n,
arg_max(case when event_type = 'purchase' then event_id end, case when event_type = 'purchase' then (ts, event_id) end) over w as last_purchase
from events window w as (partition by user_id % 3 order by ts, event_id rows between unbounded preceding and current row)""")
def window_running_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of users hold all rows; each is cut into stretches, so none is a task of its own."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("grp"), F.round(F.col("value") * 100).cast("long").alias("c"), "event_type")
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return running(events, "grp", ["ts", "event_id"], {"cents": F.col("c"), "n": F.lit(1)}, {"last_purchase": purchase}, rows=200).select("event_id", "cents", "n", "last_purchase")


@query("""with g as (select user_id % 5 as grp, ts, case when ts < lag(ts) over w + interval 20 minute then 0 else 1 end as opens from events window w as (partition by user_id % 5 order by ts)),
s as (select grp, ts, sum(opens) over (partition by grp order by ts rows between unbounded preceding and current row) as session from g)
select grp, cast(session as bigint) as session, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as "start", count(*) as n from s group by grp, session""")
def window_sessions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("grp"), "ts")
    return sessions(events, "grp", "ts", 20 * 60, rows=100).select("grp", "session", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")
