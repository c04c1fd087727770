"""File formats, partitioned and bucketed tables. Scratch files go to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset a local folder, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, fmt: str, label: str, **options: str) -> DataFrame:
    """`df` written in a format and read back with its own schema: no inference pass over the data."""
    path = scratch(df.sparkSession, label)
    df.write.format(fmt).options(**options).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**options).load(path)


_SUPPLIER = "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"


@query(_SUPPLIER)
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "supplier"), "parquet", "parquet")


@query(_SUPPLIER)
def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "supplier"), "orc", "orc")


@query(_SUPPLIER)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "supplier"), "csv", "csv", header="true", escape='"')


@query(_SUPPLIER)
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "supplier"), "json", "json")


@query(_SUPPLIER)
def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "supplier"), "xml", "xml", rowTag="row")


@query("select n_name as value from nation")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "text", "text")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table: the filter prunes folders and never reaches the files."""
    path = scratch(spark, "partitioned")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return spark.read.parquet(path).where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")


@query("select o_orderkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def source_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables bucketed by the join key: their join and the count by it need no shuffle."""
    names = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        names.append(f"millrace_{name}_{uuid.uuid4().hex}")
        table(spark, sf_dir, name).select(key).write.bucketBy(8, key).sortBy(key).format("parquet").option("path", scratch(spark, name)).saveAsTable(names[-1])
    orders, lineitem = map(spark.table, names)
    return orders.hint("merge").join(lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))
