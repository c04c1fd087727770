"""Projections and predicates. All of them reach the parquet scan where Spark can push them down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge from lineitem")
def filter_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(price, 6).alias("charge"))


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_shipdate <= timestamp '1998-09-02' and l_quantity > 40 and l_discount >= 0.05")
def filter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").where(before & (F.col("l_quantity") > 40) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_partkey", "l_quantity")


@query("select p_partkey, p_name from part where p_size in (1, 5, 9, 10, 18, 24, 33, 41, 50) and p_retailprice between 901 and 1500 and p_name like '%widget' and regexp_matches(p_brand, '[1-5]$')")
def filter_in_between_like_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").where(c("p_size").isin(1, 5, 9, 10, 18, 24, 33, 41, 50) & c("p_retailprice").between(901, 1500) & c("p_name").like("%widget") & c("p_brand").rlike("[1-5]$")).select("p_partkey", "p_name")


@query("""select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band,
coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment from customer""")
def filter_case_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, sf_dir, "customer").select("c_custkey", band.alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"))


@query("""with v as (select s_suppkey as k, case when s_suppkey % 3 = 0 then null else s_nationkey end as a, case when s_suppkey % 5 = 0 then null else s_nationkey end as b from supplier)
select k, a is null as a_null, a = b as equal, a is not distinct from b as same from v""")
def filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 3 != 0, n).alias("a"), F.when(k % 5 != 0, n).alias("b"))
    return v.select("k", F.col("a").isNull().alias("a_null"), (F.col("a") == F.col("b")).alias("equal"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("select p_partkey, cast(floor(p_retailprice) as bigint) as whole, try_cast(replace(substr(p_brand, 7), '1', 'x') as integer) as digit, greatest(p_size, 10) as at_least, least(p_size, 10) as at_most from part")
def filter_casts_and_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands without a 1 cast to a number, the others to null."""
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("whole"), F.replace(F.substring("p_brand", 7, 9), F.lit("1"), F.lit("x")).try_cast("int").alias("digit"), F.greatest(c("p_size"), F.lit(10)).alias("at_least"), F.least(c("p_size"), F.lit(10)).alias("at_most"))
