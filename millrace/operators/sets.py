"""Sorting, limits, set operations, common table expressions and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import register, table, tables


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TakeOrderedAndProject: each task keeps 100 rows, there is no global sort."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("""select k, row_number() over (order by v asc nulls last, k) as place from (select s_suppkey as k, case when s_suppkey % 4 > 0 then s_acctbal end as v from supplier) order by place limit 200""")
def sort_null_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("v"))
    top = rows.orderBy(F.asc_nulls_last("v"), "k").limit(200)
    from pyspark.sql import Window

    return top.select("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("v"), "k")).cast("long").alias("place"))


@query("select c_custkey from customer order by c_acctbal, c_custkey limit 20 offset 30")
def sort_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_acctbal", "c_custkey").offset(30).limit(20).select("c_custkey")


@query("select l_orderkey, l_linenumber, l_returnflag from lineitem where l_returnflag = 'A'")
def sort_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stratified sample: all rows of one stratum, none of another or of those not named. Shares between are in the tests."""
    return table(spark, sf_dir, "lineitem").sampleBy("l_returnflag", {"A": 1.0, "R": 0.0}, seed=7).select("l_orderkey", "l_linenumber", "l_returnflag")


_A, _B = "select c_nationkey as k from customer where c_acctbal > {}", "select s_nationkey as k from supplier where s_acctbal > {}"


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    return customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), supplier.where("s_acctbal > 4000").select(F.col("s_nationkey").alias("k"))


def _sql(op: str) -> str:
    return f"{_A.format(9000)} {op} {_B.format(4000)}"


@query(_sql("union"))
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


@query(_sql("union all"))
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b)


@query(_sql("intersect"))
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query(_sql("intersect all"))
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


@query(_sql("except"))
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


@query(_sql("except all"))
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


_TREE = """with recursive tree(part, depth, cost, path) as (select p_partkey, 0, p_retailprice, cast(p_partkey as varchar(4000)) from part where p_partkey = 0
union all select p.p_partkey, depth + 1, cost + p.p_retailprice, cast(path || '/' || p.p_partkey as varchar(4000)) from part p join tree on cast(floor(p.p_partkey / 4) as bigint) = tree.part where p.p_partkey > 0)
select part, depth, round(cost, 2) as cost, path from tree"""


@query(_TREE)
def set_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree in which four are built into one: the depth, path and price of all that each part goes into.

    Each level joins the whole table again. By the size of its files it would be broadcast, through the driver, once a level: it is merged.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default ends at a million rows
    register(spark, sf_dir, ("part",))
    return spark.sql(_TREE.replace("select p.p_partkey", "select /*+ merge(p, tree) */ p.p_partkey"))


_ABOVE = "select l_orderkey, l_partkey, l_quantity from lineitem a where l_quantity > (select 1.4 * avg(l_quantity) from lineitem b where b.l_partkey = a.l_partkey)"


@query(_ABOVE)
def set_correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("lineitem",))
    return spark.sql(_ABOVE)


@query("select distinct o_orderstatus, o_orderpriority from orders")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select p_partkey, unnest(string_split(p_type, ' ')) as word from part")
def set_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))
