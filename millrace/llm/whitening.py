"""Whitening of embeddings by a tiled covariance matrix.

Vectors become integers, x = floor(scale * component) + shift, so that sums over any number of rows are exact. A first pass
adds up every dimension. A second cuts the rows into blocks of `block_rows` and these into column blocks of `tile`
dimensions, deals the column blocks out by row block, and multiplies every pair of tiles there, centred before multiplying;
products are added up by the key of their tile pair and cell. Only those sums, one for each pair of dimensions, reach the
driver, which assembles the matrix and takes its eigenvectors; their number follows the dimensions, never the rows.
Each row is then projected on the first components and divided by the roots of their eigenvalues. What is left between the
covariance of the result and the identity is measured by the same tiled pass over the result.

Nulls and edges: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and those of another
length than the most common one (the longer of two equally common); a null id is kept, and rows that repeat are each
counted and returned. Components without variance (eigenvalue at most 1e-12 of the largest, a share of rounding) can't be
whitened and are left out, so a single row, or rows all alike, give no row, as does an empty table. A deviation beyond 64
bits is null (n above some 10^6 rows with a wide spread), never a wrong number. Other columns play no part, whatever their
names. Sums of squares of integers are exact; the covariance is rounded as doubles are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import written

SCALE, SHIFT = 1024, 100_000
TILE, BLOCK_ROWS = 32, 4096
#: An eigenvalue of at most this share of the largest is no variance.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of the integer vectors, by dimension
    values: np.ndarray  # falling eigenvalues, those with variance
    vectors: np.ndarray  # dimensions x components
    trace: float


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, x: the rows that take part."""
    v = F.col("__v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("__v")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    size = rows.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if size is not None:
        rows = rows.where(F.size(v) == size["dims"])
    return rows.select("id", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)).alias("x"))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of an Arrow list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


def sums_by_dimension(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                part = matrix(batch.column(0), np.int64).sum(axis=0)
                n, total = n + len(batch), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    parts = rows.select("x").mapInArrow(run, "n long, s array<long>")
    by = parts.select("n", F.posexplode("s").alias("d", "v")).groupBy("d").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("d").collect()
    return (by[0]["n"] if by else 0), [r["v"] for r in by]


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off as an integer, so that only the small rest is rounded."""
    if x.dtype == np.int64:
        whole = sums // n
        return (x - whole).astype(np.float64) - (sums - whole * n) / n
    return x - sums / n


def tiled_covariance(rows: DataFrame, vector_col: str, n: int, sums: list, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Covariance, divisor n, of the vectors (long or double entries), whose sums by dimension are known."""
    spark, dims = rows.sparkSession, len(sums)
    whole = isinstance(rows.schema[vector_col].dataType.elementType, LongType)
    kind = np.int64 if whole else np.float64
    edges = [(t, t * tile, min(dims, (t + 1) * tile)) for t in range(-(-dims // tile))]
    shared = spark.sparkContext.broadcast(np.array(sums, kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column blocks of the partition's rows, keyed by row block."""
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, len(batch), block_rows):
                x = matrix(batch.column(0).slice(a, block_rows), kind)
                cells = [np.ascontiguousarray(x[:, lo:hi]).tobytes() for _, lo, hi in edges]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(edges), pa.int64()), pa.array([t for t, _, _ in edges], pa.int32()), pa.array([len(x)] * len(edges), pa.int32()), pa.array(cells, pa.binary())], ["block", "tile", "n", "cells"])
                block += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of all tile pairs of a row block, whose column blocks stand together; added up over the task's blocks."""
        held: dict[tuple[int, int], np.ndarray] = {}
        now, columns = None, {}

        def pair() -> None:
            for i, a in columns.items():
                for j, b in columns.items():
                    if i <= j:
                        product = a.T @ b
                        held[i, j] = held[i, j] + product if (i, j) in held else product

        for batch in batches:
            for block, t, rows_, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    pair()
                    now, columns = block, {}
                _, lo, hi = edges[t]
                columns[t] = centred(np.frombuffer(cells, kind).reshape(rows_, hi - lo), shared.value[lo:hi], n)
        pair()
        for (i, j), product in held.items():
            row, col = np.indices(product.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(row.size, k, np.int32)) for k in (i, j)] + [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(product.ravel())], ["i", "j", "r", "c", "v"])

    blocks = rows.select(vector_col).mapInArrow(cut, "block long, tile int, n int, cells binary")
    dealt = blocks.repartition("block").sortWithinPartitions("block", "tile")
    products = dealt.mapInArrow(multiply, "i int, j int, r int, c int, v double")
    out = np.zeros((dims, dims))
    for i, j, r, c, v in products.groupBy("i", "j", "r", "c").agg(F.sum("v").alias("v")).toLocalIterator():
        out[i * tile + r, j * tile + c] = out[j * tile + c, i * tile + r] = v / n
    return out


def fit(rows: DataFrame, components: int, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> Whitening | None:
    """The leading components of the integer vectors `x`; None where there are no rows."""
    n, sums = sums_by_dimension(rows)
    if not n:
        return None
    cov = tiled_covariance(rows, "x", n, sums, tile, block_rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values[: components] > FLAT * max(values[0], 0.0)
    values, vectors = values[:components][some], vectors[:, :components][:, some]
    # A fixed sign: each component's largest entry is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, tuple(sums), values, vectors, float(np.trace(cov)))


def deviations(x: np.ndarray, sums: tuple[int, ...], n: int) -> list[int | None]:
    """sum((n * x - sums)^2) of each row, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s - n * w for s, w in zip(sums, whole.tolist(), strict=True)]
    far = x - whole
    most = int(np.abs(far).max(initial=0))
    if (n * (most + 1)) ** 2 * len(sums) < 1 << 63:
        return ((n * far - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    found = (sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in far.tolist())
    return [d if d < 1 << 63 else None for d in found]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row that takes part and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(integer_vectors(df, id_col, vector_col), "integers")
    model = fit(rows, components, tile, block_rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], StructType([StructField(id_col, id_type)])).selectExpr(f"`{id_col}`", *(f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in out.split(", ")))
    shared = spark.sparkContext.broadcast(model)
    schema = StructType([StructField("id", id_type), StructField("deviation", LongType()), StructField("w", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scaled = m.vectors / np.sqrt(m.values)
        for batch in batches:
            for a in range(0, len(batch), block_rows):
                part = batch.slice(a, block_rows)
                x = matrix(part.column(1), np.int64)
                w = centred(x, np.array(m.sums, np.int64), m.n) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(deviations(x, m.sums, m.n), pa.int64()), lists.cast(arrow.field(2).type)], schema=arrow)

    done = written(rows.mapInArrow(project, schema), "whitened")
    k = len(model.values)
    at = done.select(*(F.sum(F.col("w")[c]).alias(f"s{c}") for c in range(k))).first()
    error = float(np.abs(tiled_covariance(done, "w", model.n, list(at), tile, block_rows) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    each = done.select("id", "deviation", F.posexplode("w").alias("p", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("p")].alias("explained"), F.lit(error).alias("identity_error"))
