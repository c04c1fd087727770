"""op11: runs against brute force, on random words, on whole tables and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic, queries


def brute(w):
    """All (start, length, smallest period), by comparing every pair of places."""
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in dropped)))


piece = st.lists(st.integers(0, 3), max_size=20)


@given(st.lists(st.tuples(piece, st.integers(1, 8)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_runs_equal_brute_force(parts):
    w = [x for words, times in parts for x in words * times]
    assert periodic.runs(np.array(w, np.int32)) == brute(w)


@given(st.lists(st.integers(0, 1), max_size=120))
@settings(max_examples=200, deadline=None)
def test_runs_of_two_words_equal_brute_force(w):
    assert periodic.runs(np.array(w, np.int32)) == brute(w)


@pytest.mark.parametrize("period", [1, 5, 6, 7, 14, 15, 30, 31, 100, 333])
def test_runs_of_every_scale_are_found_at_every_place(period):
    rng = np.random.default_rng(period)
    for at in range(9):
        w = np.concatenate((1000 + np.arange(at), np.resize(np.arange(period), max(12, 2 * period)), [999], rng.integers(2000, 3000, 50))).astype(np.int32)
        assert (at, max(12, 2 * period), period) in periodic.runs(w)
        short = np.delete(w, at + max(12, 2 * period) - 1)
        assert not [r for r in periodic.runs(short) if r[2] == period]


def test_chunks_of_blocks_give_the_same_runs(monkeypatch):
    rng = np.random.default_rng(3)
    w = np.concatenate((np.resize(rng.integers(0, 9, 70), 900), np.zeros(300), np.resize([1, 0, 1, 1], 500), np.zeros(300))).astype(np.int32)
    whole = periodic.runs(w)
    monkeypatch.setattr(periodic, "CHUNK", 64)
    assert periodic.runs(w) == whole == brute(w.tolist())


def test_long_repetitive_texts_stay_near_linear():
    a, b = [0], [0, 1]
    while len(b) < 40_000:
        a, b = b, b + a
    for w in (np.zeros(300_000, np.int32), np.array(b, np.int32), np.r_[np.tile([0, 1], 4000), np.tile([1, 0], 4000)].astype(np.int32)):
        assert periodic.runs(w)  # seconds; comparing all pairs would take hours


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs}
    assert sum(v[0] > 0 for v in got.values()) > 10


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a " * 40, "x y  z " * 30, "b c " * 6, "b c " * 5, "w " + "d e f g " * 3000, "😀 \u0000 é " * 12]
    rows = [(k if k != 3 else None, t, "s", 1, 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, runs string, start int, collapsed long")
    for planted in (False, True):
        got = sorted((tuple(r) for r in periodic.digests(periodic.find_runs(df, planted=planted)).collect()), key=str)
        assert got == sorted(((r[0], *expected(r[0], r[1], planted)) for r in [*rows, rows[4], rows[4]]), key=str)
    assert periodic.digests(periodic.find_runs(df.limit(0))).count() == 0
