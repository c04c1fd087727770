"""Star joins over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import tables


@query("""
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, count(*) as n
from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey
join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by n_name""")
def star_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation where customer and supplier share it. The sizes of the small sides are Catalyst's to check."""
    region, nation, customer, orders, lineitem, supplier = tables(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem", "supplier")
    dated = orders.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")
    placed = dated.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(supplier.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    named = sold.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count("*").alias("n"))


@query("""select lang, quality, toxic, count(*) as n, round(avg(length(text)), 4) as mean_chars from documents d join labels l on d.doc_id = l.doc_id group by lang, quality, toxic""")
def star_labels_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by language: the texts give their lengths before the join, so no text is shuffled."""
    documents, labels = tables(spark, sf_dir, "documents", "labels")
    sizes = documents.select("doc_id", "lang", F.length("text").alias("chars"))
    return sizes.join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("chars"), 4).alias("mean_chars"))
