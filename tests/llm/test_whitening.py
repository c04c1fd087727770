"""op13: whitening against numpy on the whole table, tiles of any size, wide spreads and odd rows."""

import numpy as np
import pytest

from millrace.llm import queries, whitening


def check(rows, got, k):
    """`rows` of (id, vector) that take part, against the query's rows."""
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    cov = ((x - s / n).T @ (x - s / n)) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1)) and len(got) == n * k
    order = sorted(range(n), key=lambda i: (str(rows[i][0]), x[i].tolist()))
    big = [[int(v) for v in r] for r in x]
    deviation = [sum((n * v - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in big]
    for c, found in by.items():
        want = (x - s / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        have = {(str(r["vec_id"]), r["deviation"], round(abs(r["whitened"]), 6)) for r in found}
        assert have == {(str(rows[i][0]), deviation[i], round(abs(want[i]), 6)) for i in order}
        assert all(r["n"] == n and abs(r["explained"] / (values[c - 1] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found)
        signs = {np.sign(r["whitened"]) * np.sign(want[i]) for r in found for i in order if rows[i][0] == r["vec_id"] and abs(want[i]) > 1e-3 and deviation[i] == r["deviation"]}
        assert n > 1000 or len(signs) == 1  # either sign, the same for all rows


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op13_whitening(spark, sf).collect(), 8)


@pytest.mark.parametrize("tile,block_rows", [(1, 7), (5, 1), (12, 64), (64, 4096)])
def test_tiles_and_row_blocks_of_any_size(spark, tile, block_rows):
    rng = np.random.default_rng(tile)
    x = (rng.standard_normal((150, 12)) * np.arange(1, 13) * 3 + 50).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(5)
    check(list(enumerate(x)), whitening.whiten(df, components=5, tile=tile, block_rows=block_rows).collect(), 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 4.0, 2.0]), (2, [2.0, -4.0, 2.5]), (None, [0.5, 0.0, -1.0]), (2, [2.0, -4.0, 2.5]), (3, [0.0, 0.0, 0.0])]
    bad = [(4, None), (5, []), (6, [1.0, None, 1.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, inf, 1.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, id int, x string, whitened double")
    check(good, whitening.whiten(df).collect(), 3)
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id > 3")):
        assert whitening.whiten(none).collect() == []
    assert whitening.whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_are_left_out(spark):
    x = [(k, [float(k), 2.0 * k, 7.0]) for k in range(20)]
    got = whitening.whiten(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1}
    check(x, got, 1)


def test_deviations_are_exact_or_null():
    x = np.array([[10**6, -(10**6)], [3, 5]], np.int64)
    for n, sums in ((7, (123, -456)), (10**9, (10**9 * 5 + 1, 3))):
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
        assert whitening.deviations(x, sums, n) == [v if v < 2**63 else None for v in want]
