"""Selection, scans over hot keys, dyadic ranges, shared passages and exact neighbours against plain forms, on odd rows too."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import nearest
from millrace.operators.joins import dyadic_cover, range_aggregate, range_join, range_parts
from millrace.operators.nearest import exact_neighbours
from millrace.operators.overlap import shared_passages
from millrace.operators.scans import running, sessions, with_stretches
from millrace.operators.selection import exact_percentiles


@pytest.mark.parametrize("pivots,small", [(3, 1), (8, 16), (64, 4096)])
def test_selection_equals_percentile(spark, pivots, small):
    rng = random.Random(pivots)
    rows = [("wide", rng.uniform(-1e9, 1e9)) for _ in range(900)] + [("same", 7.0)] * 500 + [("mostly", 1.0)] * 700 + [("mostly", float(k)) for k in range(40)]
    rows += [(None, 3.0), (None, 5.0), ("one", -0.5), ("none", None), ("wide", None), ("", 4.0), ("tiny", 1e-300), ("tiny", 1e300), ("tiny", -1e300)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "tenth": 0.1, "mid": 0.5, "top": 1.0}
    got = {r["g"]: [r[n] for n in shares] for r in exact_percentiles(df, "g", "v", shares, pivots, small).collect()}
    want = {r["g"]: list(r)[1:] for r in df.where("v is not null").groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items())).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-12), g
    assert exact_percentiles(df.limit(0), "g", "v", shares).count() == 0


def test_selection_never_gathers_a_group(spark):
    """Of 40,000 values in one group no array holds more than `small`."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.xxhash64("id") % 100_003).cast("double").alias("v"))
    found = exact_percentiles(df, "g", "v", {"p": 0.37}, small=64)
    assert found.first()["p"] == df.agg(F.percentile("v", 0.37)).first()[0]


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(5)
    begin = datetime(2024, 1, 1)
    rows = [(k, rng.choice(["hot", "hot", "hot", "warm", None]), begin + timedelta(seconds=rng.randint(0, 40_000)), rng.choice([None, 1, 5, -2])) for k in range(3000)]
    rows += [(3000 + k, "hot", begin + timedelta(seconds=777), 1) for k in range(300)] + [(4000, "one", begin, None), (4001, "hot", None, 2), (4002, None, None, 3)]
    return spark.createDataFrame(rows, "id long, k string, at timestamp_ntz, v long").repartition(7)


@pytest.mark.parametrize("rows", [50, 400, 10**9])
def test_running_equals_one_window_a_key(timed, rows):
    got = running(timed, "k", ["at", "id"], {"total": F.col("v"), "n": F.lit(1)}, {"last": F.when(F.col("v") > 0, F.col("v") + F.col("id"))}, rows)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = timed.select("*", F.sum("v").over(w).alias("total"), F.count("*").over(w).alias("n"), F.last(F.when(F.col("v") > 0, F.col("v") + F.col("id")), True).over(w).alias("last"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.limit(0).columns == want.columns


@pytest.mark.parametrize("rows", [50, 10**9])
@pytest.mark.parametrize("gap", [5, 60])
def test_sessions_equal_one_window_a_key(timed, rows, gap):
    got = sessions(timed, "k", "at", gap, rows)
    w = Window.partitionBy("k").orderBy("at", "id")
    late = F.col("at") >= F.lag("at").over(w) + F.make_dt_interval(secs=F.lit(gap).cast("decimal(18,6)"))
    plain = timed.where("k is not null and at is not null").withColumn("new", F.coalesce(late, F.lit(True)).cast("int"))
    plain = plain.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = plain.groupBy("k", "session").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_many_stretches(timed):
    sizes = with_stretches(timed, "k", "at", 50).where("k = 'hot' and at is not null").groupBy("__stretch").count().collect()
    assert len(sizes) >= 25 and sorted(r["count"] for r in sizes)[-2] <= 200  # the largest are 300 rows with one time
    assert with_stretches(timed.where("k = 'one'"), "k", "at", 50).select("__stretch").distinct().count() == 1


def test_dyadic_covers_hold_each_number_once(spark):
    rng = random.Random(2)
    ranges = [(a, a + rng.randint(-2, 40)) for a in range(-45, 45)] + [(0, 0), (5, 4), (-(1 << 59), 1 << 59), (-1, (1 << 40) + 3), (7, 7 + 10**12)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        cells = sorted((c["cell"] << c["level"], c["level"]) for c in r["c"])
        at = r["a"]
        for start, level in cells:  # they stand side by side, from a to b
            assert start == at
            at += 1 << level
        assert at == max(r["b"] + 1, r["a"]) and len(cells) <= 2 * max(1, (r["b"] - r["a"] + 1)).bit_length()


def test_ranges_of_any_width_equal_the_nested_loop(spark):
    rng = random.Random(4)
    points = spark.createDataFrame([(k, rng.choice([rng.uniform(-1e6, 1e6), rng.uniform(-20, 20), float(rng.randint(-5, 5))])) for k in range(400)] + [(900, None), (901, float("nan")), (902, float("inf")), (903, 1e300)], "id long, p double")
    ranges = [(k, x, x + 10 ** rng.randint(0, 6)) for k in range(60) for x in [rng.uniform(-1e5, 1e5)]] + [(70, 1.0, 1.0), (71, 2.0, 1.0), (72, None, 5.0), (73, float("-inf"), 0.5), (74, -3.0, float("inf"))]
    right = spark.createDataFrame(ranges, "k long, lo double, hi double")
    for width in (0.25, 10.0, 1e5):
        got = range_join(points, right, F.col("p"), F.col("lo"), F.col("hi"), width)
        want = points.crossJoin(right).where("p >= lo and p <= hi").select(*got.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert range_join(points, right.limit(0), F.col("p"), F.col("lo"), F.col("hi"), 1.0).count() == 0


def parts():
    return {"n": (F.count("*"), F.sum), "least": (F.min("id"), F.min), "ids": (F.sum("id"), F.sum)}


def test_aggregates_of_ranges_equal_the_nested_loop(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.uniform(-1e6, 1e6), rng.uniform(-20, 20), float(rng.randint(-5, 5)), 0.1 * rng.randint(-30, 30)]) for _ in range(600)]
    points = spark.createDataFrame(list(enumerate([*values, None, float("nan"), float("inf"), 1e300, float("-inf"), -0.0])), "id long, p double").repartition(4)
    ranges = [(k % 50, x, x + 10 ** rng.randint(-1, 6)) for k in range(80) for x in [rng.choice([rng.uniform(-1e5, 1e5), *values[:9]])]] + [(70, 1.0, 1.0), (71, 2.0, 1.0), (72, None, 5.0), (73, float("-inf"), 0.5), (74, -3.0, float("inf")), (75, 0.3, 0.7), (76, 0.3, 0.7), (None, 0.0, 9.0)]
    right = spark.createDataFrame(ranges, "k long, lo double, hi double")
    want = points.crossJoin(right).where("p >= lo and p <= hi").groupBy("k", "lo", "hi").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.sum("id").alias("ids"))
    want = sorted(map(tuple, want.collect()), key=str)
    for width in (0.01, 0.25, 1e5):
        assert sorted(map(tuple, range_aggregate(points, right, "p", "lo", "hi", width, parts()).select("k", "lo", "hi", *parts()).collect()), key=str) == want
    assert range_aggregate(points, right.limit(0), "p", "lo", "hi", 1.0, parts()).count() == range_aggregate(points.limit(0), right, "p", "lo", "hi", 1.0, parts()).count() == 0


def test_ranges_meet_cells_and_not_points(spark):
    """20,000 points in each of 300 ranges are 6 million pairs; what is put together is some two parts a level for each range."""
    points = spark.range(20_000).select("id", (F.col("id") * 0.37).alias("p"))
    ranges = spark.range(300).select(F.col("id").alias("k"), (-1.0 - F.col("id")).alias("lo"), (8000.0 + F.col("id")).alias("hi"))
    assert range_parts(points, ranges, "p", "lo", "hi", 0.01, parts()).count() < 300 * 2 * 22
    assert {tuple(r)[3:] for r in range_aggregate(points, ranges, "p", "lo", "hi", 0.01, parts()).collect()} == {(20_000, 0, 19_999 * 10_000)}


def longest_common(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
    return best


def test_shared_passages_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = "the of and a to in is on it as".split() + [f"w{k}" for k in range(30)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(0, 40)) for _ in range(8)] + [["the"] * 30, ["the", "of"] * 12]
    texts = []
    for _ in range(40):
        item, own = rng.choice(items), say(rng.randint(0, 30))
        a = rng.randint(0, max(0, len(item) - 5))
        texts.append(own[:9] + item[a : a + rng.randint(5, 30)] + own[9:] + rng.choice([[], item[:7]]))
    docs = spark.createDataFrame([(k, "\n ".join(t).upper() if k % 2 else " ".join(t), 1) for k, t in enumerate(texts)] + [(100, None, 1), (101, "", 1), (None, " ".join(items[0]), 1)], "doc_id long, text string, h int").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    for least, n in ((6, 3), (10, 4), (9, 9)):
        got = {tuple(r)[:2]: tuple(r)[2:] for r in shared_passages(docs, bench, "doc_id", "item_id", least=least, n=n).collect()}
        want = {}
        for d, t in enumerate(texts):
            for i, s in enumerate(items):
                m, x, y = longest_common(t, s)
                if m >= least:
                    want[d, i] = (-x, -y, m)
        assert got == want
    assert shared_passages(docs.limit(0), bench, "doc_id", "item_id").count() == shared_passages(docs, bench.limit(0), "doc_id", "item_id").count() == 0


def test_exact_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.standard_normal((150, 8)), rng.standard_normal((20, 8)).repeat(10, axis=0) + 0.01 * rng.standard_normal((200, 8)), np.zeros((15, 8)), 1000 + rng.standard_normal((3, 8)), 1e7 + rng.standard_normal((30, 8))))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0], 1), (903, [float("nan")] * 8, 1), (904, [None] * 8, 1), (None, [1.0] * 8, 1), (3, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, id int").repartition(4)
    for pivots, block in ((None, 8192), (40, 16), (1, 64)):
        got = {}
        for q, rank, i, score in exact_neighbours(df, F.col("vec_id") % 7 == 0, "vec_id", "embedding", k=5, pivots=pivots, block_rows=block, block_queries=8).collect():
            got.setdefault(q, []).append((rank, i, round(score, 9)))
        assert set(got) == set(range(0, len(x), 7))
        for q, found in got.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            want = sorted((d[k], k) for k in range(len(x)) if k != q)[:5]
            assert sorted(found) == [(n + 1, k, round(float(v), 9)) for n, (v, k) in enumerate(want)]
    assert exact_neighbours(df.limit(0), F.lit(True), "vec_id", "embedding").count() == 0
    assert exact_neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0, "vec_id", "embedding").count() == 2


def test_vectors_of_queries_are_not_broadcast(spark, monkeypatch):
    """Repeated vectors make small files, by whose size Spark took them for the small side of a join: the pivots' counts are it."""
    plans = {}

    def kept(df, label, write=nearest._kept):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df, label)

    monkeypatch.setattr(nearest, "_kept", kept)
    df = spark.range(200).select("id", F.array(*(F.rand(k) for k in range(4))).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exact_neighbours(df, F.col("id") % 20 == 0, "id", "v").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for label in ("near", "rest"):
        assert plans[label].count("BuildRight") == 2 and "BuildLeft" not in plans[label]
