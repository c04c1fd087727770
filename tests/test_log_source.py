"""The log format: filters that reach the source, files they rule out, aborted writes, streams by offsets."""

import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.sources import log


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(path):
    return os.listdir(path.removeprefix("file://") + "/data")


def test_filters_reach_the_source_and_rule_out_files(spark, path):
    rows = [(k, float(k), f"s{k:03d}", None if k % 10 else k) for k in range(200)] + [(200, float("nan"), None, None), (None, None, "x", None)]
    df = spark.createDataFrame(rows, "i long, v double, s string, n int")
    log.write_log(df.repartitionByRange(5, F.coalesce("i", F.lit(500))), path)
    read = log.read_log(spark, path, df.schema)
    for cond in ("i = 7", "i > 150", "i >= 199", "v < 3", "v <= 3.0", "v > 195", "s = 's042'", "s >= 's190'", "n > 150", "i > 10 and v < 12 and s <= 's011'", "i in (3, 4)", "i is null", "n is not null", "not (i > 5)", "v = double('nan')"):
        assert sorted(str(tuple(r)) for r in read.where(cond).collect()) == sorted(str(tuple(r)) for r in df.where(cond).collect()), cond
    assert "Filter (" not in plan(read.where("i > 150 and v < 170.0").select("i"))
    assert "Filter (" in plan(read.where("i % 2 = 1").select("i"))
    assert read.count() == 202 and read.where("i = 3").count() == 1 and read.count() == 202  # one plan's filters are no other's
    reader = log.Reader(path)
    left = list(reader.pushFilters([log.GreaterThan(("i",), 150), log.IsNotNull(("i",)), log.EqualTo(("a", "b"), 1), log.LessThan(("i",), None)]))
    assert len(left) == 2 and len(reader.held) == 2
    assert 0 < len(reader.partitions()) < len(files(path)) == 5


def test_null_columns_and_unknown_bounds(spark, path):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "i int, v double").coalesce(1)
    log.write_log(df, path)
    read = log.read_log(spark, path, df.schema)
    assert read.where("i > 0").count() == 0 and read.where("v > 5").count() == 1 and read.count() == 2


def test_empty_tables_and_replacement(spark, path):
    df = spark.range(10)
    log.write_log(df.limit(0), path)
    assert log.read_log(spark, path, df.schema).count() == 0
    log.write_log(df, path)
    log.write_log(df.where("id < 3"), path)
    assert log.read_log(spark, path, df.schema).count() == 13
    log.write_log(df.where("id > 7"), path, "overwrite")
    assert [r["id"] for r in log.read_log(spark, path, df.schema).orderBy("id").collect()] == [8, 9]


def test_an_aborted_write_leaves_nothing(spark, path):
    df = spark.range(0, 1000, 1, 4)
    log.write_log(df, path)
    before = sorted(files(path))
    broken = df.select(F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        log.write_log(broken, path)
    until = time.time() + 20
    while sorted(files(path)) != before and time.time() < until:  # tasks that still ran delete what they wrote
        time.sleep(0.2)
    assert sorted(files(path)) == before and log.Folder(path).versions() == [1]
    assert log.read_log(spark, path, df.schema).count() == 1000


def test_a_stream_takes_each_commit_once(spark, path, tmp_path):
    from millrace.streaming.events import run

    df, seen = spark.range(30), []
    for k in range(3):
        log.write_log(df.where(F.col("id") % 3 == k), path)
        stream = spark.readStream.format(log.NAME).schema(df.schema).option("path", path).load()
        run(stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r["id"] for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True))
    assert [s for s in seen if s] == [list(range(k, 30, 3)) for k in range(3)]
