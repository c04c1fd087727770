"""Exact nearest neighbours by Euclidean distance, without a table of all pairs.

Candidates are filed under the nearest of some pivots, each with the radius that holds its own. A query first meets the
pivots nearest to it, until they hold k candidates: the k-th distance there bounds what it looks for. Then it meets only the
pivots that the triangle inequality can't rule out, distance to the pivot less the radius within the bound. Queries and
candidates meet in blocks as one matrix product; each keeps k rows a query, and these are merged before and after a
shuffle, so that a query never has more than k rows a block. What the product finds near is measured again by differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table
from millrace.sources.formats import scratch

#: Pivots: the root of the number of candidates, this many at most. More candidates make larger files, cut in blocks.
MOST_PIVOTS, BLOCK_ROWS, BLOCK_QUERIES = 1024, 4096, 1024
#: Distances that are held at once.
STEP = 1 << 20


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product; off by rounding alone."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T), 0.0))


def rounding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far `distances` squared may be off: for each row of `a`, against the longest of `b`."""
    return 1e-13 * ((a**2).sum(axis=1) + (b**2).sum(axis=1).max(initial=0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as their bytes; those are a quarter of what lists of numbers take in a worker."""
    return np.frombuffer(b"".join(column.tolist()), np.float64).reshape(len(column), -1)


def exact_neighbours(df: DataFrame, asked: Column, id_col: str, vector_col: str, k: int = 10, pivots: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, id, score: for the rows that `asked` admits the k nearest other rows, ties to the smaller id.

    Rows with a null id or a vector that is null, empty or has null or non-finite entries take no part, nor do those of another
    length than the most common one. Of rows that repeat an id one counts.
    """
    spark = df.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asked.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    size = rows.groupBy(F.size("v").alias("dims")).agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = rows.where(F.size("v") == size["dims"]).groupBy("id").agg(F.max(F.struct("v", "asked")).alias("r")).select("id", "r.v", "r.asked")
    chosen = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(pivots or max(1, min(MOST_PIVOTS, round(size["n"] ** 0.5))))
    shared = spark.sparkContext.broadcast(np.array([r["v"] for r in chosen.select("v").collect()], np.float64))

    def file(batches):
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK_QUERIES):
                part = pdf.iloc[a : a + BLOCK_QUERIES].copy()
                x = np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)
                d = distances(x, shared.value)
                yield part.assign(v=[r.tobytes() for r in x], pivot=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    filed = _kept(rows.mapInPandas(file, "id long, v binary, asked boolean, pivot int, far double"), "filed")
    held = filed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each pivot
    count, radius = (np.zeros(len(shared.value)) for _ in range(2))
    for r in held:
        count[r["pivot"]], radius[r["pivot"]] = r["n"], r["radius"]
    table_ = spark.sparkContext.broadcast((count, radius))

    def meeting(first: bool):
        def run(batches):
            n, r = table_.value
            for whole in batches:
                for a in range(0, len(whole), BLOCK_QUERIES):
                    pdf = whole.iloc[a : a + BLOCK_QUERIES]
                    x = _matrix(pdf["v"])
                    d = distances(x, shared.value)
                    order = np.argsort(d, axis=1, kind="stable")
                    enough = np.cumsum(n[order], axis=1) - n[order] < k + 1  # the nearest pivots, until they hold k others
                    near = np.zeros_like(enough)
                    np.put_along_axis(near, order, enough, axis=1)
                    if not first:
                        slack = 2 * np.sqrt(rounding(x, shared.value))[:, None] + 1e-9 * (d + r)
                        near = ~near & (d - r - slack <= pdf["bound"].to_numpy()[:, None]) & (n > 0)
                    q, p = np.nonzero(near)
                    for c in range(0, len(q), STEP >> 6):
                        at = q[c : c + (STEP >> 6)]
                        yield pd.DataFrame({"q": pdf["id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "bound": pdf["bound"].to_numpy()[at], "pivot": p[c : c + (STEP >> 6)].astype(np.int32)})

        return run

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        q, c, ids = _matrix(queries["v"]), _matrix(candidates["v"]), candidates["id"].to_numpy()
        keys, bounds, found = queries["q"].to_numpy(), queries["bound"].to_numpy(), []
        step = max(1, STEP // len(c))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            for key, row, at, bound, off in zip(keys[a : a + step], part, distances(part, c), bounds[a : a + step], rounding(part, c), strict=True):
                rough = min(bound, np.partition(at, k)[k] if len(at) > k + 1 else np.inf)
                near = np.flatnonzero(at**2 <= rough**2 * (1 + 1e-9) + 2 * off)
                near = near[ids[near] != key]
                score = np.sqrt(((c[near] - row) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                found.append((np.full(len(best), key), ids[near][best], score[best]))
        return pd.DataFrame(dict(zip(("q", "id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    has = filed.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cb"))

    def met(asking: DataFrame, label: str) -> DataFrame:
        asking = _kept(asking, "asking")
        # A row a pivot. The other side repeats vectors, which its files hold once: by their size it would be broadcast, unpacked, itself.
        blocks = F.broadcast(has.join(asking.groupBy("pivot").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("qb")), "pivot"))
        slot = lambda key, n: F.pmod(F.xxhash64(key, F.lit(3)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asking.join(blocks, "pivot").withColumn("x", slot("q", "qb")).withColumn("y", every("cb")).select("pivot", "x", "y", "q", "v", "bound")
        right = filed.join(blocks, "pivot").withColumn("y", slot("id", "cb")).withColumn("x", every("qb")).select("pivot", "x", "y", "id", "v")
        keys = ["pivot", "x", "y"]
        return _kept(left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(meet, "q long, id long, score double"), label)

    best = Window.partitionBy("q").orderBy("score", "id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    queries = filed.where("asked").select("id", "v").withColumn("bound", F.lit(float("inf")))
    schema = "q long, v binary, bound double, pivot int"
    near = met(queries.mapInPandas(meeting(True), schema), "near")
    bounds = top(near).where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("bound"))
    rest = queries.drop("bound").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = near.union(met(rest.mapInPandas(meeting(False), schema), "rest"))
    return top(found).select(F.col("q").alias("query_id"), "rank", "id", "score")


@query("""with q as (select vec_id as query_id, cast(embedding as double[]) as a from embeddings where vec_id % 20 = 0), c as (select vec_id, cast(embedding as double[]) as b from embeddings),
d as (select query_id, vec_id, list_distance(a, b) as score from q join c on query_id <> vec_id),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, round(score, 9) as score from r where rank <= 10""")
def join_exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors to each one whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    found = exact_neighbours(vectors, F.col("vec_id") % 20 == 0, "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))
