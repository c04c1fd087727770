"""User-defined functions, all in Arrow batches: scalar, aggregate, table and grouped-map.

They serve what builtins can't express; the queries here have builtin equals so that results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def udf_pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(net("l_extendedprice", "l_discount"), 4).alias("net"))


@query("select c_custkey, upper(c_mktsegment) as segment from customer")
def udf_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("string")
    def upper(v: pa.Array) -> pa.Array:
        return pc.utf8_upper(v)

    return table(spark, sf_dir, "customer").select("c_custkey", upper("c_mktsegment").alias("segment"))


@query("select p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) as weighted from part group by p_brand")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def weighted(v: pd.Series, w: pd.Series) -> float:
        return float((v * w).sum() / w.sum())

    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(weighted("p_retailprice", F.col("p_size").cast("double")), 6).alias("weighted"))


@query("select n_nationkey, unnest(range(0, n_regionkey + 1)) as step from nation")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="step: bigint")
    class Steps:
        def eval(self, n: int) -> Iterator[tuple[int]]:
            for i in range(n + 1):
                yield (i,)

    spark.udtf.register("millrace_steps", Steps)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("select n_nationkey, step from nation, lateral millrace_steps(n_regionkey)")


@query("select user_id, event_id, round(value - avg(value) over (partition by user_id), 10) as centred from events")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(centred=rows["value"] - rows["value"].mean())[["user_id", "event_id", "centred"]]

    done = table(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(centre, "user_id long, event_id long, centred double")
    return done.select("user_id", "event_id", F.round("centred", 10).alias("centred"))


@query("select o_orderkey, o_totalprice > 100000 as large from orders where o_orderstatus = 'F'")
def udf_map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.greater(b.column(1), 100000)], names=["o_orderkey", "large"])

    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").mapInArrow(mark, "o_orderkey long, large boolean")
