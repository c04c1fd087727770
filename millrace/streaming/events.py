"""Streams over `events`: watermarks, tumbling, sliding and session windows, dedup, joins, arbitrary state.

A stream reads the table's Parquet files with an explicit schema, event time as a zoned timestamp (a timestamp without
zone carries no watermark), and runs with the availableNow trigger into a Parquet sink or, for complete and update
modes, through foreachBatch into Parquet. Results are read back from the sink, so nothing passes through the driver; the
memory sink alone keeps them there, and serves results of a few rows.

Windows are appended once, when the watermark has passed their end, and their state goes with them. The windows that
the last watermark has not passed are therefore not in the results: the SQL leaves them out too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.catalog import query
from millrace.session import table
from millrace.sources.formats import scratch


def stream(spark: SparkSession, sf_dir: str, name: str = "events", at: str = "ts", delay: str = "1 hour", files_per_batch: int = 1000) -> DataFrame:
    """`name` as a stream with a watermark on `at`. A table that is one file is read by its folder and a name filter."""
    batch = table(spark, sf_dir, name)
    reader = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch)
    path = f"{sf_dir}/{name}.parquet"
    found = {f.rpartition("/")[0] for f in batch.inputFiles()}
    one_file = not any(f.rstrip("/").endswith(f"{name}.parquet") for f in found)
    source = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one_file else reader.parquet(path)
    return source.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def finish(out: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs `out` over all that is there and gives the sink's rows: the last batch's in complete mode, else all."""
    spark = out.sparkSession
    sink, checkpoint = scratch(spark, f"{label}-sink"), scratch(spark, f"{label}-checkpoint")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", sink)
    else:  # a file sink takes appended rows only
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(sink))
    run(writer)
    return spark.read.schema(out.schema).parquet(sink)


def run(writer: DataStreamWriter) -> list[dict]:
    """Runs until all that is there has been read; gives what Spark reports of each batch."""
    done = writer.start()
    done.awaitTermination()
    return done.recentProgress


def _text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


#: What the last watermark, an hour behind the latest event, has passed; event times count in milliseconds there.
_MARK = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"

#: Later than any timer; so many users share a key of the sessions by timers.
_NEVER, USERS_A_KEY = np.iinfo(np.int64).max, 128


@query(f"""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events
where date_trunc('hour', ts) + interval 1 hour <= {_MARK} group by start, event_type""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return finish(counted, "append", "tumbling").select(_text("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""with w as (select time_bucket(interval 15 minute, ts) - k * interval 15 minute as begins from events, (select unnest(range(0, 4)) as k))
select strftime(begins, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from w where begins + interval 1 hour <= {_MARK} group by start""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stream(spark, sf_dir).groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"))
    return finish(counted, "append", "sliding").select(_text("window.start").alias("start"), "n")


@query(f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k having max(ts) + interval 30 minute <= {_MARK}""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stream(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return finish(counted, "append", "session").select("user_id", _text("session_window.start").alias("start"), "n")


@query("select event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, as from a source that delivers at least once; an id is remembered for the delay, an hour."""
    twice = stream(spark, sf_dir).union(stream(spark, sf_dir))
    return finish(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "append", "dedup")


@query("select event_type, count(*) as n from events group by event_type")
def stream_memory_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode into the memory sink: one row for each event type, however many events there are."""
    name = f"millrace_{uuid.uuid4().hex}"
    counted = stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    run(counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "memory-checkpoint")))
    return spark.table(name)


@query("select event_id, user_id, round(value * 2, 4) as twice from events where event_type = 'purchase'")
def stream_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", F.round(F.col("value") * 2, 4).alias("twice")), "append", "stateless")


@query("""select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase'
and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold their state only as long as the watermark and the interval can still match it."""
    side = lambda kind, i, t: stream(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("event_id").alias(i), F.col("user_id").alias(f"u{i}"), F.col("ts").alias(t))
    joined = side("click", "a", "at").join(side("purchase", "b", "bt"), F.expr("ua = ub and bt >= at and bt <= at + interval 1 hour"))
    return finish(joined.select("a", "b"), "append", "join")


class Counter(StatefulProcessor):
    """Events and total value of each user; a user silent for `IDLE_MS` of event time is forgotten and starts anew."""

    IDLE_MS = 30 * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "n bigint, total double, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, until = self.state.get() if self.state.exists() else (0, 0.0, 0)
        last = until
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
            last = max(last, int(pdf["at_ms"].max()) + self.IDLE_MS)
        if last > until:
            if until:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(last)
        self.state.update((n, total, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


@query("select user_id, count(*) as n, round(sum(value), 3) as total from events group by user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_ms = (F.unix_micros("ts") / 1000).cast("long").alias("at_ms")
    grouped = stream(spark, sf_dir).select("user_id", "value", "ts", at_ms).groupBy("user_id")
    out = grouped.transformWithStateInPandas(Counter(), "user_id bigint, n bigint, total double", "Update", "EventTime")
    done = with_rocksdb(spark, lambda: finish(out, "update", "state"))
    return done.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 3).alias("total"))


def in_batches(spark: SparkSession, sf_dir: str, batches: int = 4, files: int = 4, name: str = "events", at: str = "ts") -> DataFrame:
    """`name` as a stream of `batches` batches in order of time: ranges of `at` are written one after the other, each as `files` files.

    The file source takes files by their age, so each batch is one range.
    """
    rows = table(spark, sf_dir, name)
    edges = rows.select(F.percentile_approx(F.unix_micros(F.col(at).cast("timestamp")), [k / batches for k in range(1, batches)]).alias("e")).first()["e"] or []
    folder, micros = scratch(spark, f"{name}-batches"), F.unix_micros(F.col(at).cast("timestamp"))
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = rows.where((F.lit(True) if low is None else micros > low) & (F.lit(True) if high is None else micros <= high))
        part.repartition(files).write.mode("append").parquet(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return source.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, "1 hour")


class Sessions(StatefulProcessor):
    """Open sessions of the users of a key; a session's row comes when the watermark has passed `GAP_MS` after its last event.

    A key is a user or a group of users, null users by themselves under a null key. It has one timer, for the session that ends first;
    what it finds ended goes out as one frame, so that calls and frames follow the keys and not the sessions.
    """

    GAP_MS = 30 * 60 * 1000
    COLUMNS = ("user_id", "first", "last", "n")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")  # rows of COLUMNS; a list state would be a call a row

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        fresh = [np.stack([pdf["user_id"].to_numpy() if key[0] is not None else at * 0, at, at, at * 0 + 1], axis=1).astype(np.int64) for pdf in rows for at in [pdf["at_us"].to_numpy()]]
        merged = self._merged(np.concatenate([held, *fresh]))
        self.open.update((merged.tobytes(),))
        due, before = self._ends(merged).min(), self._ends(held).min(initial=_NEVER)
        if due != before:
            if len(held):
                self.handle.deleteTimer(int(before))
            self.handle.registerTimer(int(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = self._ends(held) <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone, left = held[over], held[~over]
        if len(left):
            self.open.update((left.tobytes(),))
            self.handle.registerTimer(int(self._ends(left).min()))
        else:
            self.open.clear()
        if len(gone):
            users = pd.array(gone[:, 0] if key[0] is not None else [None] * len(gone), dtype="Int64")
            yield pd.DataFrame({"user_id": users, "start_us": gone[:, 1], "end_us": gone[:, 2], "n": gone[:, 3]})

    def close(self) -> None:
        pass

    def _held(self) -> np.ndarray:
        rows = self.open.get()
        return np.frombuffer(rows[0] if rows else b"", np.int64).reshape(-1, len(self.COLUMNS))

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        """Sessions of rows that are sessions or events, by user and time."""
        s = pd.DataFrame(rows, columns=list(self.COLUMNS)).sort_values(["user_id", "first"], kind="stable")
        users, first = s["user_id"].to_numpy(), s["first"].to_numpy()
        upto = s.groupby("user_id")["last"].cummax().to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], (users[1:] != users[:-1]) | (first[1:] - upto[:-1] >= self.GAP_MS * 1000))))
        return np.stack([users[begins], first[begins], np.maximum.reduceat(s["last"].to_numpy(), begins), np.add.reduceat(s["n"].to_numpy(), begins)], axis=1)

    def _ends(self, sessions: np.ndarray) -> np.ndarray:
        """In milliseconds, as timers count, up."""
        return -(-sessions[:, 2] // 1000) + self.GAP_MS


def with_rocksdb(spark: SparkSession, make):
    """`make()` while the session keeps state in RocksDB, which arbitrary state needs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return make()
    finally:
        spark.conf.set(provider, before)


@query(f"""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as "end", count(*) as n from s group by user_id, k having max(ts) + interval 30 minute <= {_MARK}""")
def stream_session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in four batches by arbitrary state: every row comes from a timer that ended, in this batch or a later one.

    The state's keys are groups of some `USERS_A_KEY` users, whose sessions are merged together as arrays.
    """
    users = table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0]
    group = F.pmod(F.xxhash64("user_id"), F.lit(-(-users // USERS_A_KEY) or 1))
    rows = in_batches(spark, sf_dir).where("ts is not null").select(F.when(F.col("user_id").isNotNull(), group).alias("users"), "user_id", "ts", F.unix_micros("ts").alias("at_us"))
    keyed = rows.groupBy("users")
    out = keyed.transformWithStateInPandas(Sessions(), "user_id bigint, start_us bigint, end_us bigint, n bigint", "Append", "EventTime")
    done = with_rocksdb(spark, lambda: finish(out, "append", "session-timers"))
    return done.select("user_id", _text_of_micros("start_us").alias("start"), _text_of_micros("end_us").alias("end"), "n")


def _text_of_micros(c: str):
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")
