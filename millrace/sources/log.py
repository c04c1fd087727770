"""A table format of its own through the Python DataSource API: Arrow files that count once a commit names them.

A table is a folder: `data` holds Arrow files, `commits` numbered lists of them, with each file's rows and the least and
greatest value of its columns. A write adds files and then one list, in one rename, so readers see all of it or nothing; an
aborted write deletes its files. Reading is a partition a file, without those whose values a pushed filter rules out. As a
stream the offset is the number of the last commit. A task that ends after its write was aborted finds a mark and deletes
what it wrote itself. The folder is any that pyarrow opens and that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from millrace.catalog import query
from millrace.session import table
from millrace.sources.formats import scratch

NAME = "millrace_log"
#: A column with the name of a row's file, filled in where a schema has it.
FILE = "_file"
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class Folder:
    """The table's folder and its commits."""

    def __init__(self, path: str):
        self.path = path
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def versions(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def listed(self, after: int = 0, upto: int | None = None) -> list[dict]:
        """Files of the commits with numbers in (after, upto]; a commit that replaces the table begins anew."""
        out: list[dict] = []
        for v in self.versions():
            if v > after and (upto is None or v <= upto):
                with self.files.open_input_stream(f"{self.root}/commits/{v}.json") as f:
                    commit = json.loads(f.read())
                out = commit["files"] if commit["replaces"] else out + commit["files"]
        return out

    def commit(self, added: list[dict], replaces: bool) -> None:
        self.files.create_dir(f"{self.root}/commits")
        draft = f"{self.root}/commits/{uuid.uuid4().hex}.draft"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps({"replaces": replaces, "files": added}).encode())
        self.files.move(draft, f"{self.root}/commits/{max(self.versions(), default=0) + 1}.json")

    def abort(self, job: str) -> None:
        """Leaves a mark for the job's tasks that still run, and deletes what the others wrote."""
        self.files.create_dir(f"{self.root}/aborted")
        with self.files.open_output_stream(f"{self.root}/aborted/{job}"):
            pass
        for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True)):
            if f.base_name.startswith(job):
                self.discard(f.base_name)

    def aborted(self, job: str) -> bool:
        return self.files.get_file_info(f"{self.root}/aborted/{job}").type != fs.FileType.NotFound

    def discard(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/data/{name}").type != fs.FileType.NotFound:
            self.files.delete_file(f"{self.root}/data/{name}")

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(f"{self.root}/data/{name}") as f:
            reader = pa.ipc.open_file(f)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)


def bounds(batch: pa.RecordBatch, before: dict) -> dict:
    """Least and greatest value by column, of numbers and strings; null where a column has had nulls only."""
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = column.type
        if pa.types.is_integer(kind) or pa.types.is_string(kind) or (pa.types.is_floating(kind) and not pc.any(pc.is_nan(column)).as_py()):
            found = pc.min_max(column).as_py()
            low, high = before.get(name) or (None, None)
            lows, highs = [v for v in (low, found["min"]) if v is not None], [v for v in (high, found["max"]) if v is not None]
            before[name] = (min(lows), max(highs)) if lows else None
        elif pa.types.is_floating(kind):
            before[name] = (None, None)  # NaN is greater than any number: nothing is known
    return before


@dataclass
class OneFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    file: dict | None


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, replaces: bool):
        self.path, self.replaces, self.job = path, replaces, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name = Folder(self.path), f"{self.job}-{uuid.uuid4().hex}.arrow"
        folder.files.create_dir(f"{folder.root}/data")
        rows, seen, sink, out = 0, {}, None, None
        try:
            for batch in iterator:
                if out is None:
                    sink = folder.files.open_output_stream(f"{folder.root}/data/{name}")
                    out = pa.ipc.new_file(sink, batch.schema)
                out.write_batch(batch)
                rows, seen = rows + len(batch), bounds(batch, seen)
            if out is None:
                return Written(None)
            out.close()
            sink.close()
            if folder.aborted(self.job):
                raise RuntimeError("the write was aborted")
            return Written({"name": name, "rows": rows, "bounds": seen})
        except BaseException:  # what a failed task has begun goes, then the failure goes on
            if sink is not None:
                sink.close()
                folder.discard(name)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.path).commit([m.file for m in messages if m is not None and m.file], self.replaces)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).abort(self.job)


class Reader(DataSourceReader):
    def __init__(self, path: str, named: bool = False):
        self.path, self.named, self.held = path, named, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column with a number or string are done here, by files and by rows; the rest stays with Spark."""
        for f in filters:
            compares = type(f) in _COMPARE and type(f.value) in (int, float, str) and f.value == f.value
            if len(f.attribute) == 1 and (compares or isinstance(f, IsNotNull)):
                self.held.append(f)
            else:
                yield f

    def needs(self, file: dict) -> bool:
        for f in self.held:
            known = file["bounds"].get(f.attribute[0], (None, None))
            if known is None:  # nulls only, which no filter lets through
                return False
            low, high = known
            if type(f) not in _COMPARE or low is None or isinstance(low, str) != isinstance(f.value, str):
                continue
            below = type(f) in (LessThan, LessThanOrEqual, EqualTo) and not (low <= f.value if type(f) is not LessThan else low < f.value)
            above = type(f) in (GreaterThan, GreaterThanOrEqual, EqualTo) and not (high >= f.value if type(f) is not GreaterThan else high > f.value)
            if below or above:
                return False
        return True

    def partitions(self) -> list[OneFile]:
        return [OneFile(f["name"]) for f in Folder(self.path).listed() if self.needs(f)] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        for batch in Folder(self.path).batches(partition.name) if partition.name else ():
            if self.named:
                batch = batch.append_column(FILE, pa.array([partition.name] * len(batch), pa.string()))
            for f in self.held:
                column = batch.column(f.attribute[0])
                if isinstance(f, IsNotNull):
                    mask = pc.is_valid(column)
                else:
                    mask = _COMPARE[type(f)](column, pa.scalar(f.value))
                    if pa.types.is_floating(column.type) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                        mask = pc.or_kleene(mask, pc.is_nan(column))  # to Spark NaN is the greatest
                batch = batch.filter(mask)
            if len(batch):
                yield batch


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max(Folder(self.path).versions(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return [OneFile(f["name"]) for f in Folder(self.path).listed(start["commit"], end["commit"])] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from Folder(self.path).batches(partition.name)

    def commit(self, end: dict) -> None:
        """Commits stay: other readers may begin with them."""


class LogSource(DataSource):
    """Option `path`: the table's folder. A schema must be given to read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], FILE in schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"])


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(LogSource)
    df.write.format(NAME).option("path", path).mode(mode).save()


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows. Spark 4.1 keeps what was last pushed into a loaded source, and a plan that pushes nothing would get

    that plan's rows; so every plan pushes one filter at least, that a row has a file."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    named = StructType([*schema.fields, StructField(FILE, StringType())])
    return spark.read.format(NAME).schema(named).option("path", path).load().where(F.col(FILE).isNotNull()).select(*schema.names)


@query("select event_id, user_id, round(value, 4) as value from events where value > 150 and event_type = 'purchase' and user_id <= 60")
def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two commits, files by ranges of user; the filters are the source's, and rule out files."""
    events, path = table(spark, sf_dir, "events"), scratch(spark, "log")
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
        write_log(part.repartitionByRange(4, "user_id"), path)
    read = read_log(spark, path, events.schema).where((F.col("value") > 150.0) & (F.col("event_type") == "purchase") & (F.col("user_id") <= 60))
    return read.select("event_id", "user_id", F.round("value", 4).alias("value"))


@query("select event_type, count(*) as n, count(distinct user_id) as users, min(event_id) as first_event from events group by event_type")
def source_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream that is stopped and taken up again: commits come once each, by their offsets."""
    from millrace.streaming.events import run

    events, path = table(spark, sf_dir, "events"), scratch(spark, "log")
    sink, checkpoint = scratch(spark, "log-sink"), scratch(spark, "log-checkpoint")
    for part in (events.where("event_id % 3 > 0"), events.where("event_id % 3 = 0")):
        write_log(part, path)
        stream = spark.readStream.format(NAME).schema(events.schema).option("path", path).load()
        run(stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True))
    return spark.read.schema(events.schema).parquet(sink).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_event"))
