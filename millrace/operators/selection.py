"""Exact order statistics of groups of any size: selection by counting value ranges, not by sorting or buffering a group.

Each pass takes pivots from a sketch of the values still in question and counts, for each group, how many values fall
between and on them; map-side sums make that a few rows a group and task. The class that holds the wanted rank goes to the
next pass. Values on a pivot are a class of their own, so a value that fills most of a group is found at once, and every
pass narrows what is left to about one in `PIVOTS`. Classes of at most `SMALL` values are sorted as arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.formats import scratch

PIVOTS, SMALL = 64, 4096


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _classes(values: DataFrame, keys: list[str], pivots: int) -> DataFrame:
    """keys, class, n, low, high: how many values are in each class of each key, classes in rising order of values."""
    at = [(k + 1) / (pivots + 1) for k in range(pivots)]
    cuts = values.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__v", at)).alias("__cuts"))
    v = F.col("__v")
    place = 2 * F.size(F.filter("__cuts", lambda p: p < v)) + F.array_contains("__cuts", v).cast("int")
    return values.join(cuts, keys).groupBy(*keys, place.alias("__class")).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))


def exact_percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float], pivots: int = PIVOTS, small: int = SMALL) -> DataFrame:
    """`by`, and for each name of `shares` the percentile of `value` there, interpolated between the two nearest ranks.

    Null values are left out, a group that has no others is no row; NaN counts as the largest value; null groups are a group.
    """
    values = df.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("__text"), F.col(by).isNull().alias("__null"), F.col(by).alias("__by"), F.col(value).cast("double").alias("__v")).where("__v is not null")
    group = ["__text", "__null"]  # the group as a key that is never null
    counted = _kept(_classes(values, group, pivots), "classes")
    names = _kept(values.groupBy(*group).agg(F.first("__by").alias("__by"), F.count("*").alias("__n")), "groups")
    ranks = []
    for name, share in shares.items():
        h = F.lit(float(share)) * (F.col("__n") - 1)
        ranks += [names.select(*group, F.lit(name).alias("__name"), F.lit(up).alias("__up"), (F.ceil(h) if up else F.floor(h)).cast("long").alias("__rank")) for up in (False, True)]
    wanted = reduce(DataFrame.union, ranks)
    found: list[DataFrame] = []
    low_high: list[str] = []
    while True:
        keys = [*group, *low_high]
        upto = Window.partitionBy(*keys).orderBy("__class").rowsBetween(Window.unboundedPreceding, 0)
        spans = counted.withColumn("__end", F.sum("n").over(upto)).withColumn("__start", F.col("__end") - F.col("n"))
        held = wanted.join(spans, keys).where("__rank >= __start and __rank < __end")
        held = held.select(*group, "__name", "__up", (F.col("__rank") - F.col("__start")).alias("__rank"), "n", F.col("low").alias("__low"), F.col("high").alias("__high"))
        held = _kept(held, "held")
        same = F.col("__low") == F.col("__high")
        found.append(held.where(same).select(*group, "__name", "__up", F.col("__low").alias("__found")))
        few = held.where(~same & (F.col("n") <= small))
        low_high = ["__low", "__high"]
        inside = lambda some: values.join(some.select(*group, *low_high).distinct(), group).where("__v >= __low and __v <= __high")  # noqa: B023, E731
        arrays = inside(few).groupBy(*group, *low_high).agg(F.sort_array(F.collect_list("__v")).alias("__all"))
        found.append(few.join(arrays, [*group, *low_high]).select(*group, "__name", "__up", F.get("__all", F.col("__rank").cast("int")).alias("__found")))
        wanted = held.where(~same & (F.col("n") > small)).drop("n")
        if wanted.isEmpty():
            break
        counted = _kept(_classes(inside(wanted), [*group, *low_high], pivots), "classes")
    both = reduce(DataFrame.union, found).groupBy(*group, "__name").agg(F.max(F.when(~F.col("__up"), F.col("__found"))).alias("a"), F.max(F.when(F.col("__up"), F.col("__found"))).alias("b"))
    at = both.join(names, group)
    h = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.col("__name")).cast("double") * (F.col("__n") - 1)
    exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (h - F.floor(h)) * (F.col("b") - F.col("a")))
    wide = at.groupBy(*group).agg(F.first("__by").alias(by), *(F.max(F.when(F.col("__name") == name, exact)).alias(name) for name in shares))
    return wide.drop(*group)
