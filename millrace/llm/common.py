"""What the operators of this subpackage share: table reading, scratch tables, batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters of text that one step of a Python worker handles at once (a longer text is a step of its own).
STEP_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of texts, for a query: batches for Python are kept small, and rows are dealt out where its files make fewer tasks

    than there are cores (one row group, say)."""
    small_batches(spark)
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset a local one, for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
    return _LOCAL[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: it cuts lineage and survives lost executors.

    Its shuffle files go as soon as it is written: nothing else reads them.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}", spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by `written`; only for those that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steps_of(sizes: Iterable[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` characters each, so that memory follows `limit`, not the batch."""
    start = end = chars = 0
    for size in sizes:
        end, chars = end + 1, chars + int(size)
        if chars >= limit:
            yield start, end
            start, chars = end, 0
    if start < end:
        yield start, end


def steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    return steps_of((len(t or "") for t in texts), limit)


#: Rows and bytes of text that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what texts need, so that memory follows these bounds. Never raises them.

    Batches are the session's, so this is for queries, which own it, to call: operators leave settings alone.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < size_of(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def size_of(text: str) -> int:
    """Bytes of a size as Spark's settings have it: a number, and b, k, m, g or t (kb and so on) after it."""
    found = re.fullmatch(r"(-?[0-9]+)(?:b|([kmgt])b?)?", text.strip().lower())
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ")


def over_texts(df: DataFrame, kept: list[str], text: str, schema: str, rows: Callable[[list[str | None]], dict[str, Iterable]]) -> DataFrame:
    """Applies `rows` to the texts, step by step; `kept` columns go through unchanged before the new ones of `schema`.

    The text may be one of the kept columns; it is then sent once.
    """

    new = _parse_datatype_string(schema)
    out = StructType([*(df.schema[c] for c in kept), *new.fields])
    arrow = to_arrow_schema(out)
    n_kept = len(kept)
    at = kept.index(text) if text in kept else n_kept
    sent = [F.col(c) for c in kept] + [F.col(text)] * (at == n_kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in steps(texts):
                made = rows(texts[a:b])
                columns = [batch.column(k).slice(a, b - a).cast(arrow.field(k).type) for k in range(n_kept)]
                columns += [pa.array(made[f.name], type=arrow.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*sent).mapInArrow(run, out)
