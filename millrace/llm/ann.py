"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

The index: centroids from k-means on a bounded sample (`sample` vectors with the smallest hash), about as many as the root of
the number of vectors (a quarter of the sample at most, 4,096 by default: lists of more than 17 million vectors grow, and
are scanned in blocks), and every vector filed under its nearest centroid. A query probes
the lists with the nearest centroids. How many is measured where it is not given: among `TRIALS` vectors of the sample, the
fewest lists that hold a share `goal` of their true nearest neighbours in the sample. Where they hold fewer than k others, a
query probes further ones until there are as many.

Vectors are rotated by one random orthogonal matrix, so that any part of the coordinates is a fair sample of the whole
distance, and scanned in column blocks. After d of D columns of a candidate as far as the bound the partial squared distance
is the bound's times a Beta(d / 2, (D - d) / 2) variable: a candidate is abandoned where its partial distance exceeds what
that variable exceeds with a chance of `alpha`. The bound is the query's k-th nearest distance so far: it falls from chunk
to chunk of a list, and is carried from list to list: the nearest lists are scanned first, and what they find bounds the scan of the
others. What is left at the end is measured exactly, on the original vectors, in double precision. The share of all
coordinates of probed candidates that were read comes with the result.

Equal vectors are one candidate and one query: of copies only the k + 1 smallest ids can appear in a result, and a
window limit keeps just those before the shuffle. Lists are cut into blocks of about `block_rows` candidates and
`block_queries` queries; each pair of blocks is one task group, so a hot list is spread over many.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than the
most common one (the longer of two equally common). Ties go to the smaller id. Rows that repeat an id are one row. A
query with fewer candidates than k gets all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 16_384
ROTATION_SEED = 7


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; rows of `x` are in a fixed order, so the result is reproducible."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (centroids**2).sum(axis=1) - 2 * x[a : a + 4096] @ centroids.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :m])
    return np.concatenate(out) if out else np.empty((0, m), np.int64)


def margins(dims: int, columns: int, alpha: float) -> list[tuple[int, float]]:
    """(columns read, share of the squared bound beyond which a candidate is abandoned) for each test."""
    t = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for d in range(columns, dims, columns):
        log = (d / 2 - 1) * np.log(t) + ((dims - d) / 2 - 1) * np.log1p(-t)
        cdf = np.cumsum(np.exp(log - log.max()))
        out.append((d, float(t[min(np.searchsorted(cdf, (1 - alpha) * cdf[-1]), len(t) - 1)])))
    return out


#: Candidates that are scanned before the bound is set anew.
CHUNK = 1024


def scan(queries: np.ndarray, candidates: np.ndarray, turned_queries: np.ndarray, turned: np.ndarray, k: int, bounds: np.ndarray, tests: list[tuple[int, float]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query: rows of the nearest candidates found, their exact distances, and how many coordinates were read.

    `bounds` holds a distance for each query that its k-th nearest is known not to exceed (inf: none is known).
    """
    dims = turned.shape[1]
    edges = [0, *(d for d, _ in tests), dims]
    limits = [share for _, share in tests]
    head = min(len(candidates), max(4 * k, 64))
    starts = [0, *range(head, len(candidates), CHUNK), len(candidates)]
    out = []
    for q, t, bound in zip(queries, turned_queries, bounds, strict=True):
        rows, far, read = np.empty(0, np.int64), np.empty(0), 0
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            alive, partial = np.arange(a, b), np.zeros(b - a)
            for n, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                part = turned[a:b, x:y] if len(alive) == b - a else turned[alive, x:y]
                partial = partial + ((part - t[x:y]) ** 2).sum(axis=1)
                read += part.size
                share = limits[n] if n < len(limits) else 1.0
                ok = partial <= bound**2 * share * (1 + 1e-9) + 1e-12
                if not ok.all():
                    alive, partial = alive[ok], partial[ok]
            if len(alive):
                rows = np.concatenate((rows, alive))
                far = np.concatenate((far, np.sqrt(((candidates[alive] - q) ** 2).sum(axis=1))))
                if len(rows) > k:  # all ties at the bound stay
                    near = far <= np.partition(far, k - 1)[k - 1]
                    rows, far = rows[near], far[near]
                if len(rows) >= k:
                    bound = min(bound, far.max())
        out.append((rows, far, read))
    return out


#: Vectors of the sample whose true neighbours tell how many lists to probe.
TRIALS = 256


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, goal: float) -> int:
    """The fewest lists that hold a share `goal` of the true k nearest neighbours of `TRIALS` rows of `x`, within `x`."""
    if len(x) <= k + 1:
        return len(centroids)
    own = nearest(x, centroids, 1)[:, 0]
    trials = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    order = nearest(x[trials], centroids, len(centroids))
    ranks = []
    for row, at in zip(order, trials, strict=True):
        place = np.empty(len(centroids), np.int64)
        place[row] = np.arange(len(centroids))
        far = ((x - x[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        ranks.append(place[own[np.argpartition(far, k)[:k]]])
    return int(np.quantile(np.concatenate(ranks), goal, method="higher")) + 1


def search(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, lists: int | None = None, probes: int | None = None, goal: float = 0.98, alpha: float = 0.001, columns: int = 16, sample: int = SAMPLE, block_rows: int = 8192, block_queries: int = 2048) -> DataFrame:
    """For each row that `is_query` admits its k nearest other rows: query_id, rank, vec_id, score, share_read."""
    spark = df.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = "query_id long, rank int, vec_id long, score double, share_read double"
    if size is None:
        return spark.createDataFrame([], schema)
    dims = size["dims"]
    # 0.0 and -0.0 are one value; adding 0.0 makes them so.
    rows = rows.where(F.size("v") == dims).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("key", F.xxhash64("v"))
    # Of equal vectors the k + 1 smallest ids are candidates; the limit works before the shuffle.
    by_vector = Window.partitionBy("key", "v").orderBy("id")
    few = rows.withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1)
    points = written(few.groupBy("key", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "points")
    asked = rows.where(is_query(F.col("id"))).select("id", "key", "v").distinct()
    asked = written(asked.withColumn("qid", F.min("id").over(Window.partitionBy("key", "v"))), "asked")
    asked_points = asked.select("qid", "v").where("id = qid")  # equal vectors are one query, named by its smallest id

    held = points.count()
    train = points.orderBy("key", F.element_at("ids", 1)).limit(sample).select("v").collect()
    x = np.array([r["v"] for r in train])
    centroids = kmeans(x, lists or max(1, min(round(held**0.5), len(x) // 4)))
    turn, tests = rotation(dims), margins(dims, columns, alpha)
    m = min(probes or probes_for(x, centroids, k, goal), len(centroids))
    first = min(m, -(-4 * (k + 1) * len(centroids) // held))  # lists whose candidates set the bound
    shared = spark.sparkContext.broadcast(centroids)

    def file(batches):
        for pdf in batches:
            yield pdf.assign(list=nearest(np.array(pdf["v"].tolist()).reshape(-1, dims), shared.value, 1)[:, 0].astype(np.int32))

    filed = written(points.mapInPandas(file, "key long, v array<double>, ids array<long>, list int"), "lists")
    held_by = np.zeros(len(centroids), np.int64)
    for r in filed.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row a list
        held_by[r["list"]] = r["n"]
    sizes = spark.sparkContext.broadcast(held_by)

    def probe(batches):
        """The nearest lists: as many as are probed, and further ones until they hold k others."""
        for pdf in batches:
            order = nearest(np.array(pdf["v"].tolist()).reshape(-1, dims), shared.value, len(shared.value))
            before = np.cumsum(sizes.value[order], axis=1) - sizes.value[order]
            pdf["list"] = [o[(np.arange(len(o)) < m) | (b <= k)].astype(np.int32) for o, b in zip(order, before, strict=True)]
            yield pdf

    probing = written(asked_points.mapInPandas(probe, "qid long, v array<double>, list array<int>").select("qid", "v", F.posexplode("list").alias("place", "list")), "probes")

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": [], "read": [], "seen": []})
        candidates = candidates.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        q, c = (np.array(x["v"].tolist()) for x in (queries, candidates))
        ids = candidates["ids"].tolist()
        rows = []
        for key, (at, far, read) in zip(queries["qid"], scan(q, c, q @ turn, c @ turn, k + 1, queries["bound"].to_numpy(), tests), strict=True):
            near = sorted((d, i) for a, d in zip(at.tolist(), far.tolist(), strict=True) for i in ids[a])[: k + 1]
            rows.append((key, None, None, read, c.size))  # what was read, found or not
            rows += [(key, i, d, 0, 0) for d, i in near]
        return pd.DataFrame(rows, columns=["qid", "vec_id", "score", "read", "seen"]).astype({"vec_id": "Int64"})

    def met(asking: DataFrame) -> DataFrame:
        # How many blocks each list has, a table of at most `lists` rows.
        has = filed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("c"))
        wanted = asking.groupBy("list").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("q"))
        blocks = F.broadcast(has.join(wanted, "list"))
        slot = lambda of, n, seed: F.pmod(F.xxhash64(of, F.lit(seed)), F.col(n)).cast("int")
        left = asking.join(blocks, "list").withColumn("qb", slot("qid", "q", 3)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("list", "qb", "cb", "qid", "v", "bound")
        right = filed.join(blocks, "list").withColumn("cb", slot("key", "c", 5)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select("list", "qb", "cb", "ids", "v")
        keys = ["list", "qb", "cb"]
        found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(meet, "qid long, vec_id long, score double, read long, seen long")
        return written(found, "met")

    of_query = Window.partitionBy("qid")
    best = of_query.orderBy(F.asc_nulls_last("score"), "vec_id")
    near = met(probing.where(F.col("place") < first).withColumn("bound", F.lit(float("inf"))))
    every = near
    if first < len(centroids):
        known = near.withColumn("at", F.row_number().over(best)).where(F.col("at") == k + 1).select("qid", F.col("score").alias("bound"))
        rest = probing.where(F.col("place") >= first).join(known, "qid", "left")
        every = near.union(met(rest.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))))
    top = every.withColumn("at", F.row_number().over(best)).withColumn("share_read", F.sum("read").over(of_query) / F.sum("seen").over(of_query)).where((F.col("at") <= k + 1) & F.col("vec_id").isNotNull()).drop("at", "read", "seen")
    # Back to the queries' own rows: copies of one vector share what was found; each leaves out itself.
    each = asked.select(F.col("id").alias("query_id"), "qid").join(top, "qid").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "share_read")
