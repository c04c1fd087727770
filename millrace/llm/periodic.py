"""Runs: stretches of words that repeat themselves, found by block matching.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(12, 2 q) long, that can't be
extended to either side. Blocks of L words, a power of two, that stand at multiples of L are looked for in the whole
document by an Aho-Corasick automaton over word numbers. Where one occurs again at a distance that suits its scale, the two
places seed a match that is extended word by word to both sides, exactly, and if it is long enough it is a run.

Scales: a run with period q has at least m = max(q, 12 - q) places whose word comes again q words later, side by side, and
2 L - 1 of them hold an aligned block of L. So periods from 2 L - 1 to 4 L - 2 are found with L (4, 8, 16 and so on), those
up to 5 with L = 4 and 6 with L = 2, and no run can be missed.

What keeps the work near linear: only blocks that can occur again within reach are searched for (each of their aligned
pieces of four words stands again no farther than the scale's greatest distance); blocks deep inside a run that is
known, where all they could show is that run, are left out; and a place that a run with a divisor of the distance covers,
or a match of the same distance that was extended before, seeds nothing.

Nulls and edges: a null text has no words and a null id edits nothing; texts of any length are taken whole, the searched
blocks in chunks of about `CHUNK` words; rows that repeat are handled each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import steps

LEAST = 12
#: Words of blocks that one automaton holds.
CHUNK = 1 << 18


def scales(n: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Block lengths for a document of n words, each with the ranges of distances that suit it; distances rise with them."""
    out = [(2, [(6, 6)]), (4, [(1, 5), (7, 14)])]
    while 2 * out[-1][0] * 2 - 1 <= n // 2:
        size = 2 * out[-1][0]
        out.append((size, [(2 * size - 1, 4 * size - 2)]))
    return out


NEVER = np.iinfo(np.int32).max


def next_distance(w: np.ndarray) -> np.ndarray:
    """For each place the distance to the next place with the same four words, `NEVER` if there is none.

    Words are compared by a hash, so that a distance may rarely be too small, which costs a search; never too large.
    """
    n, factor = len(w) - 3, np.uint64(0x9E3779B97F4A7C15)
    key = w.astype(np.uint64)
    key = ((key[:n] * factor + key[1 : n + 1]) * factor + key[2 : n + 2]) * factor + key[3 : n + 3]
    bits = np.uint64(n.bit_length())
    mark = np.sort(((key ^ (key >> np.uint64(32))) * factor) >> bits << bits | np.arange(n, dtype=np.uint64))
    place = (mark & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = mark[1:] >> bits == mark[:-1] >> bits
    out = np.full(n, NEVER, np.int32)
    out[place[:-1][same]] = (place[1:] - place[:-1])[same]
    return out


def named(w: np.ndarray, piece: int) -> np.ndarray:
    """For each place a number that stands for its next `piece` words (a power of two): equal numbers, equal words."""
    names = w.astype(np.int64)
    length = 1
    while length < piece:
        names = np.unique(names[:-length] * (int(names.max()) + 1) + names[length:], return_inverse=True)[1]
        length *= 2
    return names


def extend(w: np.ndarray, at: int, end: int, d: int) -> tuple[int, int]:
    """The places around [at, end), all equal to those d later, that are so too."""
    step = 32
    while at > 0:
        low = max(0, at - step)
        differs = np.flatnonzero(w[low:at] != w[low + d : at + d])
        if len(differs):
            at = low + int(differs[-1]) + 1
            break
        at, step = low, step * 2
    step, last = 32, len(w) - d
    while end < last:
        high = min(last, end + step)
        differs = np.flatnonzero(w[end:high] != w[end + d : high + d])
        if len(differs):
            end += int(differs[0])
            break
        end, step = high, step * 2
    return at, end


class Runs:
    """The runs of one document; `found` has (start, length, period)."""

    def __init__(self, w: np.ndarray):
        self.w, self.found = w, []
        self.reach: dict[int, int] = {}  # by distance: where the last match that was extended ends
        self.covered = np.zeros((0, 3), np.int64)  # runs as (start, end, period)
        if len(w) >= LEAST:
            self._search()

    def _search(self) -> None:
        w, n = self.w, len(self.w)
        for size, ranges in scales(n):
            if size == 2:  # of use for the distance of 6 alone
                again = w[:-6] == w[6:]
                distances = np.where(again[:-1:2] & again[1::2][: len(again[:-1:2])], 6, NEVER)
            elif size == 4:
                distances = next_distance(w)[::4]
            else:  # blocks are pairs of those of the scale before
                m = len(distances) // 2
                distances = np.maximum(distances[0 : 2 * m : 2], distances[1 : 2 * m : 2])
            far = ranges[-1][1]
            blocks = np.flatnonzero(distances <= far) * size
            if len(blocks):
                blocks = self._outside_known(blocks, size, far)
            if len(blocks):
                per = max(2, CHUNK // size)
                # Neighbours are searched together, and only in the stretch that they can reach.
                apart = np.flatnonzero(np.diff(blocks) > far + size) + 1
                for group in np.split(blocks, apart) if len(apart) else [blocks]:
                    for a in range(0, len(group), per):
                        self._match(group[a : a + per], size, ranges)
                if self.found:
                    self.found = smallest(self.found)
                    self.covered = np.array([(s, s + length, q) for s, length, q in self.found], np.int64)
            elif size > 2 and not (distances < NEVER).any():
                break  # nor has any larger block

    def _long_enough(self, least: int, period: int) -> list[list[int]]:
        """Known runs of at least so many words and at most such a period, as (start, end, period)."""
        known = self.covered
        return known[(known[:, 1] - known[:, 0] >= least) & (known[:, 2] <= period)].tolist()

    def _outside_known(self, blocks: np.ndarray, size: int, far: int) -> np.ndarray:
        """Without blocks that have all places within reach in one run whose period fits in them: they show that run alone."""
        ok = np.ones(len(blocks), bool)
        for start, end, _ in self._long_enough(size + far, size):
            a, b = np.searchsorted(blocks, (start, end - far - size + 1))
            ok[a:b] = False
        return blocks[ok]

    def _match(self, blocks: np.ndarray, size: int, ranges: list[tuple[int, int]]) -> None:
        """Searches for the blocks within reach of them; what occurs again at a suitable distance is extended.

        A block is a key of up to four numbers, each for a quarter of its words, whatever its size. The text is read once for
        each remainder of a place by the quarter's length; a number that is no word's stands between these readings.
        """
        low, high = int(blocks[0]) + ranges[0][0], min(len(self.w), int(blocks[-1]) + ranges[-1][1] + size)
        if high - low < size:
            return
        piece = max(1, size // 4)
        names = named(self.w[int(blocks[0]) : high], piece)
        border = int(names.max()) + 1
        rows = -(-(high - low - piece + 1) // piece) + 1
        readings = np.full(rows * piece, border)
        readings[: high - low - piece + 1] = names[low - int(blocks[0]) :]
        text = tuple(readings.reshape(rows, piece).T.ravel().tolist())
        places: dict[tuple, list[int]] = defaultdict(list)
        for at, key in zip(blocks.tolist(), names[(blocks - blocks[0])[:, None] + np.arange(0, size, piece)].tolist(), strict=True):
            places[tuple(key)].append(at)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ats in places.items():
            automaton.add_word(key, ats)
        automaton.make_automaton()
        seeds: list[tuple[int, int]] = []
        back = size // piece - 1
        for last, ats in automaton.iter(text):
            remainder, row = divmod(last, rows)
            there = low + remainder + (row - back) * piece
            for near, far in ranges:
                a, b = bisect_left(ats, there - far), bisect_right(ats, there - near)
                if a < b:
                    seeds += [(there - at, at) for at in ats[a:b]]
        if not seeds:
            return
        d, at = np.array(seeds).T
        # At most one run with a period of half a block or less holds a block; what it says itself seeds nothing.
        ends, periods = np.full(len(blocks), -1), np.ones(len(blocks), np.int64)
        for start, end, q in self._long_enough(size, size // 2):
            a, b = np.searchsorted(blocks, (start, end - size + 1))
            ends[a:b], periods[a:b] = end, q
        k = np.searchsorted(blocks, at)
        new = (at + size + d > ends[k]) | (d % periods[k] > 0)
        d, at = d[new], at[new]
        order = np.lexsort((at, d))
        for distance, place in zip(d[order].tolist(), at[order].tolist(), strict=True):
            if self.reach.get(distance, -1) <= place:
                self._seed(place, size, distance)

    def _seed(self, at: int, size: int, d: int) -> None:
        start, end = extend(self.w, at, at + size, d)
        self.reach[d] = end
        length = end + d - start
        if length >= max(LEAST, 2 * d):
            self.found.append((start, length, d))


def smallest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of equal stretches the one with the smallest period: a stretch of two periods or more has no smaller period but a

    divisor, and this very stretch is the divisor's run."""
    least: dict[tuple[int, int], int] = {}
    for start, length, d in found:
        least[start, length] = min(d, least.get((start, length), d))
    return [(s, n, q) for (s, n), q in least.items()]


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of the word numbers, by start, then period."""
    return sorted(Runs(w).found, key=lambda r: (r[0], r[2]))


def edit(w: np.ndarray, key: int | None) -> np.ndarray:
    """The contract's planted repetition: of documents whose key hashes so, words from some place on repeat a stretch."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n = len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((w[:a], w[a + np.arange(n - a) % p]))


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words as numbers by first occurrence, and the words by number."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words)), list(known)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Of n words those that no run has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row for each row: id, n_words, runs (by start, then period), and the text without what the runs repeat.

    With `planted` the texts are edited first (see `edit`).
    """
    out = StructType([df.schema[id_col], *_parse_datatype_string(SCHEMA).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(texts):
                rows: list[list] = [[], [], []]
                for key, text in zip(keys[a:b], texts[a:b], strict=True):
                    # bytes.split() cuts at exactly the characters that are no words: a space and 9 to 13.
                    w, names = numbered((text or "").encode("utf-8", "surrogatepass").split())
                    w = edit(w, key) if planted else w
                    found = runs(w)
                    kept = w[kept_words(len(w), found)] if found else w
                    rows[0].append(len(w))
                    rows[1].append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    rows[2].append(b" ".join(map(names.__getitem__, kept.tolist())).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(arrow.field(0).type), *(pa.array(r, arrow.field(k + 1).type) for k, r in enumerate(rows))], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the longest run's start, length, period and exponent, and digests of all runs and of the collapsed text."""
    runs_ = F.col("runs")
    first = F.array_sort(F.transform(runs_, lambda r: F.struct((-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period"))))
    top = F.when(F.size(runs_) > 0, first[0])
    lines = F.array_join(F.transform(runs_, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    shown = found.select(id_col, F.size(runs_).cast("long").alias("n_runs"), top.alias("top"), F.when(F.size(runs_) > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    length = -F.col("top.longest")
    return shown.select(
        id_col, "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.expr("1000 * -top.longest div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
