"""Sketches kept by day, and timers that end in a running stream."""

import os
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators.sketches import Store
from millrace.streaming import events


def columns():
    return F.col("ts"), F.col("kind"), F.col("user"), F.col("v")


def test_store_takes_in_new_days_alone(spark, tmp_path):
    begin = datetime(2024, 3, 4)
    rows = [(begin + timedelta(minutes=97 * k), f"k{k % 2}", k % 37, float(k % 101)) for k in range(150)] + [(None, "k0", 1, 1.0), (begin, None, None, None), (begin, "k1", 5, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, user long, v double")
    store = Store(spark, f"file://{tmp_path}/sketches")
    assert store.read().count() == 0 and store.merged(F.col("day")).count() == 0
    assert store.refresh(df.where("ts < timestamp_ntz'2024-03-08'"), *columns()) == 4
    before = sorted(os.listdir(f"{tmp_path}/sketches"))
    files = {d: os.listdir(f"{tmp_path}/sketches/{d}") for d in before if d.startswith("day=")}
    days = df.where("ts is not null").select(F.col("ts").cast("date")).distinct().count()
    assert store.refresh(df, *columns()) == days - 4 and store.refresh(df, *columns()) == 0
    assert all(os.listdir(f"{tmp_path}/sketches/{d}") == f for d, f in files.items())
    got = {(r["span"], r["grp"]): r for r in store.merged(F.date_trunc("week", "day").cast("date")).collect()}
    own = df.where("ts is not null").groupBy(F.date_trunc("week", "ts").cast("date").alias("w"), F.coalesce("kind", F.lit("")).alias("g"))
    for w, g, n, users, median in own.agg(F.count("*"), F.count_distinct("user"), F.expr("percentile_disc(0.5) within group (order by v)")).collect():
        r = got.pop((w, g))
        assert r["n"] == n and r["keys_theta"] == users and r["keys_hll"] == users and (r["quartiles"] is None if median is None else r["quartiles"][1] == median)
    assert not got


def test_merged_sketches_stay_within_their_errors(spark, tmp_path):
    df = spark.range(60_000).select((F.lit(datetime(2024, 3, 4)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 800_000 * 9).cast("decimal(18,6)"))).alias("ts"), F.lit("k").alias("kind"), (F.xxhash64("id") % 30_000).alias("user"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    store = Store(spark, f"file://{tmp_path}/sketches")
    store.refresh(df, *columns())
    r = store.merged(F.lit(0)).first()
    exact = df.agg(F.count_distinct("user").alias("n")).first()["n"]
    assert store.read().count() > 5 and abs(r["keys_hll"] / exact - 1) < 0.04 and abs(r["keys_theta"] / exact - 1) < 0.06
    for q, value in zip((0.25, 0.5, 0.75), r["quartiles"], strict=True):
        assert abs(df.where(F.col("v") <= value).count() / 60_000 - q) < 0.01


def test_timers_end_in_a_running_stream(spark, tmp_path):
    """Rows come batch by batch, from timers that the watermark has passed; a session that goes on in the next batch is one."""
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(0, at(1, 0), 1), (1, at(1, 20), 1), (2, at(2, 0), 2), (3, at(2, 59), 3), (4, at(3, 10), 3), (5, at(8, 0), 1), (6, at(8, 1), 2), (7, at(8, 2), 3), (8, at(14, 0), 9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    keyed = events.in_batches(spark, str(tmp_path), batches=3, files=1).select("user_id", "ts", F.unix_micros("ts").alias("at_us")).groupBy("user_id")
    out = keyed.transformWithStateInPandas(events.Sessions(), "user_id bigint, start_us bigint, end_us bigint, n bigint", "Append", "EventTime")
    seen = []
    writer = out.writeStream.outputMode("append").foreachBatch(lambda b, k: seen.append(sorted((r["user_id"], r["start_us"] // 60_000_000 % 1440, r["n"]) for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    events.with_rocksdb(spark, lambda: events.run(writer))
    assert sorted(x for b in seen for x in b) == [(1, 60, 2), (1, 480, 1), (2, 120, 1), (2, 481, 1), (3, 179, 2), (3, 482, 1)]
    assert len([b for b in seen if b]) > 1  # in more than one batch; the session at 14:00 is still open


def test_sessions_of_many_users_share_a_timer(spark, tmp_path):
    """Users in groups, null users too: the same sessions, an end on the watermark itself among them, and few calls whatever the sessions."""
    begin = datetime(2024, 1, 1)
    rows = [(u * 1000 + k, begin + timedelta(minutes=k * (17 if u % 3 else 45), seconds=u), u if u < 40 else None) for u in range(41) for k in range(60)]
    end = max(r[1] for r in rows) + timedelta(hours=9)
    rows += [(90_000, end, 3), (90_001, end - timedelta(minutes=90), 5), (90_002, end - timedelta(minutes=89), 6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, events.stream_session_timers(spark, str(tmp_path)).collect()), key=str)
    want = []
    for user in {r[2] for r in rows}:
        held = []
        for at in sorted(r[1] for r in rows if r[2] == user):
            if held and at - held[-1][1] < timedelta(minutes=30):
                held[-1] = (held[-1][0], at, held[-1][2] + 1)
            else:
                held.append((at, at, 1))
        want += [(user, str(a), str(b), n) for a, b, n in held if b + timedelta(minutes=30) <= end - timedelta(hours=1)]
    assert got == sorted(want, key=str) and {5, None} < {r[0] for r in got} and not any(r[0] == 6 and r[1] > str(end - timedelta(hours=2)) for r in got)


def test_a_key_has_one_timer():
    """However many sessions are open, one timer stands; when it ends, all that the watermark has passed go out in one frame."""

    class Handle:
        def __init__(self):
            self.timers, self.value = set(), None

        getListState = getValueState = lambda self, *_: self
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        put = update = lambda self, value: setattr(self, "value", value)
        clear = lambda self: setattr(self, "value", None)
        registerTimer = lambda self, t: self.timers.add(t)
        deleteTimer = lambda self, t: self.timers.remove(t)
        getCurrentWatermarkInMs = lambda self: 50 * 3_600_000
        getExpiryTimeInMs = lambda self: 1_800_000

    handle, sessions = Handle(), events.Sessions()
    sessions.init(handle)
    list(sessions.handleInputRows((1,), iter([pd.DataFrame({"user_id": [1] * 100, "at_us": [k * 3_600_000_000 for k in range(100)]})]), handle))
    assert handle.timers == {1_800_000}
    handle.timers.clear()
    out = list(sessions.handleExpiredTimer((1,), handle, handle))
    assert [len(f) for f in out] == [50] and handle.timers == {50 * 3_600_000 + 1_800_000}


def test_exact_results_hold_beyond_the_sketches(spark, tmp_path):
    """More keys and values than sketches hold; a group of one value, one of NaN, one without values or keys."""
    at = (F.lit(datetime(2024, 3, 4)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 9).cast("decimal(18,6)"))).alias("ts")
    df = spark.range(60_000).select(at, F.concat(F.lit("k"), F.col("id") % 2).alias("kind"), (F.xxhash64("id") % 30_000).alias("user"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    odd = [(datetime(2024, 3, 5), "one", 1, 7.0)] * 3 + [(datetime(2024, 3, 5), "nan", 1, float("nan")), (datetime(2024, 3, 6), "none", None, None)] + [(datetime(2024, 3, 6), "most", k, 5.0 if k > 9 else float(k)) for k in range(5000)]
    df = df.union(spark.createDataFrame(odd, "ts timestamp_ntz, kind string, user long, v double"))
    store = Store(spark, f"file://{tmp_path}/sketches")
    store.refresh(df.where("ts < timestamp_ntz'2024-03-06'"), *columns())
    store.refresh(df, *columns())
    got = {r["grp"]: (r["n"], r["keys"], str(r["quartiles"])) for r in store.exact(F.lit(0)).collect()}
    disc = F.array(*(F.expr(f"percentile_disc({q}) within group (order by v)") for q in (0.25, 0.5, 0.75)))
    want = {r[0]: (r[1], r[2], str(r[3])) for r in df.groupBy("kind").agg(F.count("*"), F.count_distinct("user"), F.when(F.count("v") > 0, disc)).collect()}
    assert got == want and len(got) == 6
