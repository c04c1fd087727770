"""Line dedup: winnowing over line hashes.

A text's units are its lines, each cut after the ends of its sentences and after one space in `CUT_ONE_IN`, since what
is copied into a text seldom starts with its line or a sentence. Which spaces those are follows from the bytes before them
alone, so two copies are cut alike wherever they stand. A window is the shortest run of units from some unit on, or up to
some unit, that has at least `min_words` words; together the windows inside a longer run cover all of it. Winnowing
selects from each window the smallest hash of a run of units with `GRAM_WORDS` words (the rightmost of equals): any run of
units with `min_words` words that two texts share has a window of its own, and so the same selected run of units in both: a
guaranteed fingerprint. Positions are joined on the fingerprints; those that occur once are done with. From each position that is left the match is
extended both ways, to its reach: all windows that select it. Where a whole reach occurs before (by id, then position),
its units are deleted; the positions that remain, if their fingerprint still occurs more than once, are matched window by
window: of windows of equal content the first stays, and the units of all later ones are deleted. What overlaps its own
first occurrence stays. A reach holds its windows wherever it occurs, so the result is that of matching all windows.

So exactly those units go that lie in a run of at least `min_words` words which occurs before. Some copy of every unit
stays. Matches are made through the first occurrence, never in pairs, and all keys are summed before they are
shuffled, so a passage that a third of all documents share costs one row for each occurrence.

Nulls and edges: a null text stays null; rows that share both id and text are treated alike, as one document; a null id
comes last; empty texts have no units; words are runs without ASCII white space, and a text without any is one unit; an
empty table gives an empty result. Equality is that of two 64-bit hashes, of the window and of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import discard, steps_of, written

MIN_WORDS = 30
#: One in this many spaces ends a unit, by the bytes before it (`TAIL` of them, one 64-bit number); sentences and lines always do.
CUT_ONE_IN, TAIL = 4, 8
#: Words of the runs of units whose hashes are winnowed: single units are often one common word, which tells nothing.
GRAM_WORDS = 8
#: Longer than any text.
WHOLE = (1 << 31) - 1
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def cut_units(data: np.ndarray, ends: np.ndarray, one_in: int = CUT_ONE_IN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, words, characters) of each unit and the units of each text; texts lie end to end in UTF-8, `ends` exclusive."""
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else ends
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none, np.zeros(len(ends), np.int64)
    at = np.flatnonzero(data == 32)
    room = at - np.repeat(starts, np.diff(np.searchsorted(at, ends), prepend=0))
    # The bytes before the space as one number, the last on top; `room` keeps them within the text.
    padded = np.concatenate((np.zeros(TAIL, np.uint8), data))
    tail = np.ndarray(len(data) + 1, "<u8", padded, strides=1)[at]
    mixed = (tail * np.uint64(_BASE)) >> np.uint64(40)
    chosen = (room >= TAIL) & (mixed % np.uint64(one_in) == 0)
    stop = (room >= 1) & _STOPS[(tail >> np.uint64(56)).astype(np.uint8)]
    is_start = np.zeros(len(data) + 1, bool)
    is_start[starts] = True
    is_start[at[chosen | stop] + 1] = True
    is_start[1:] |= data == 10
    begin = np.flatnonzero(is_start[:-1])
    ink = (data != 32) & ((data < 9) | (data > 13))
    first = ink.copy()
    first[1:] &= ~ink[:-1] | is_start[1:-1]
    words = np.add.reduceat(first, begin, dtype=np.int32).astype(np.int64)
    chars = np.add.reduceat((data & 0xC0) != 0x80, begin, dtype=np.int32).astype(np.int64)
    per_text = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    return begin, words, chars, per_text


def units_of(text: str) -> list[str]:
    """The units of one text; joined they are the text."""
    raw = text.encode("utf-8", "surrogatepass")
    bounds = [*cut_units(np.frombuffer(raw, np.uint8), np.array([len(raw)], np.int64))[0].tolist(), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def contents(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of units: polynomial in the units' hashes, shifted to the run's start; then mixed."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)))))
    content = (sums[end + 1] - sums[start]) * _powers(_INVERSE, len(hashes))[start]
    content ^= content >> np.uint64(31)
    content *= np.uint64(0xBF58476D1CE4E5B9)
    return content ^ (content >> np.uint64(29))


def reaches(start: np.ndarray, end: np.ndarray, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(selected unit, start, end) of the union of all windows that select the same unit."""
    order = np.argsort(selected, kind="stable")
    at = selected[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    if not len(first):
        return at, start, end
    return at[first], np.minimum.reduceat(start[order], first), np.maximum.reduceat(end[order], first)


def grams(hashes: np.ndarray, words: np.ndarray, gram_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, end inclusive) of the shortest run of units from each unit on that has `gram_words` words; the end is n where none has."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.maximum(np.searchsorted(total, total[:-1] + gram_words, side="left") - 1, np.arange(n))
    return contents(hashes, np.arange(n), np.minimum(end, n - 1)), end


def windows(hashes: np.ndarray, words: np.ndarray, doc_ends: np.ndarray, min_words: int, runs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end inclusive, selected, content hash) of each window; documents lie end to end, `doc_ends` exclusive.

    Selected is the rightmost smallest unit, or the first unit of the smallest of `runs` (as from `grams`) within the window.
    """
    n = len(hashes)
    empty = np.empty(0, np.int64)
    if not n:
        return empty, empty, empty, np.empty(0, np.uint64)
    total = np.concatenate(([0], np.cumsum(words)))
    below = np.concatenate(([0], np.cumsum(np.bincount(total))))  # entries of `total` below each number of words
    end = below[np.minimum(total[:-1] + min_words, len(below) - 1)] - 1
    sizes = np.diff(np.concatenate(([0], doc_ends)))
    last = np.repeat(doc_ends, sizes) - 1
    start = np.flatnonzero((end <= last) & (words > 0))  # a window starts and ends with a word
    end = end[start]
    before = below[np.maximum(total[1:] - min_words + 1, 0)] - 1
    up_to = np.flatnonzero((before >= np.repeat(doc_ends - sizes, sizes)) & (words > 0))
    both = np.concatenate((start * n + end, before[up_to] * n + up_to))
    both.sort(kind="stable")  # two ascending runs, so this merges them
    both = both[np.diff(both, prepend=-1) > 0]
    start, end = both // n, both % n
    content = contents(hashes, start, end)
    prints, until = (hashes, end) if runs is None else (runs[0], np.searchsorted(runs[1], end, side="right") - 1)
    length = until - start + 1
    # Rightmost minimum of each window: two overlapping ranges whose length is a power of two.
    selected = np.zeros(len(start), np.int64)
    best, least = np.arange(n), prints  # where the minimum of the `width` prints from each unit on is, and what it is
    level, width = 0, 1
    log = np.frexp(length.astype(np.float64))[1] - 1
    top = log.max(initial=0)
    while True:
        k = np.flatnonzero(log == level)
        a, b = start[k], until[k] - width + 1
        selected[k] = np.where(least[b] <= least[a], best[b], best[a])
        if level == top:
            break
        right = least[width:] <= least[:-width]
        best, least = np.where(right, best[width:], best[:-width]), np.where(right, least[width:], least[:-width])
        level, width = level + 1, 2 * width
    return start, end, selected, content


def _bytes_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts end to end in UTF-8, and where each ends (exclusive)."""
    wide = texts.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    return (data[at[0] : at[-1]].to_pybytes() if data is not None else b""), at[1:] - at[0]


def _planes(values: np.ndarray) -> bytes:
    """The bytes of small numbers, the lowest of all first, then the next, and so on: the upper ones compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def unit_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, hashes, sizes): for each text its units' hashes, then their words and characters, packed (`unpacked` reads them)."""

    out = StructType([df.schema[id_col], *_parse_datatype_string("th long, hashes binary, sizes binary").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for a, b in steps_of(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)):
                raw, ends = _bytes_of(batch.column(2).slice(a, b - a))
                begin, words, chars, per_text = cut_units(np.frombuffer(raw, np.uint8), ends)
                bounds = [*begin.tolist(), len(raw)]
                hashes = np.fromiter((digest(raw[i:j].strip(), 42) for i, j in zip(bounds[:-1], bounds[1:], strict=True)), np.uint64, len(begin))
                at = np.concatenate(([0], np.cumsum(per_text))).tolist()
                texts = list(zip(at[:-1], at[1:], strict=True))
                packed = [hashes[i:j].tobytes() for i, j in texts], [_planes(np.concatenate((words[i:j], chars[i:j]))) for i, j in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c, arrow.field(k + 2).type) for k, c in enumerate(packed))], schema=arrow)

    texts = df.where(F.col(text_col).isNotNull()).select(id_col, F.xxhash64(text_col).alias("th"), text_col)
    return texts.mapInArrow(run, out)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(hashes, words, first and last (exclusive) character within the text, ends of the texts) of a batch of the unit table."""
    hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
    words, sizes, after, counts = [], [], [], []
    for packed in batch.column("sizes").to_pylist():
        both = _unplaned(packed)
        n = len(both) // 2
        words.append(both[:n])
        sizes.append(both[n:])
        after.append(np.cumsum(both[n:]))
        counts.append(n)
    none = np.empty(0, np.int64)
    y = np.concatenate([none, *after])
    return hashes, np.concatenate([none, *words]), (y - np.concatenate([none, *sizes]), y), np.cumsum(counts, dtype=np.int64)


#: Documents whose units one step of a worker holds.
STEP_DOCS = 1000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP_DOCS):
            yield batch.slice(a, STEP_DOCS)


def _merged(small: DataFrame) -> DataFrame:
    """The side of a join that has one row for each key: merged at every size, so that both sides may spill and the plan

    does not change as the input grows.
    """
    return small.hint("merge")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(id, th, spans): ranges of later repeated units, as array<struct<a, b, x, y>>: units (b inclusive), characters (y exclusive); and the tables it reads."""
    units = written(unit_table(df, id_col, text_col), "units")
    kind = df.schema[id_col]

    def schema_of(fields: str) -> tuple[StructType, pa.Schema]:
        out = StructType([kind, *_parse_datatype_string(fields).fields])
        return out, to_arrow_schema(out)

    fp_schema, fp_arrow = schema_of("th long, fp long, content long, pos int, a int, b int, x int, y int")
    win_schema, win_arrow = schema_of("th long, fp long, content long, a int, b int, x int, y int")
    gram_words = min(GRAM_WORDS, min_words)

    def windows_of(batch: pa.RecordBatch) -> tuple:
        """(hashes, fingerprints, characters, ends of the texts, and the four of `windows`)"""
        hashes, words, chars, ends = unpacked(batch)
        runs = grams(hashes, words, gram_words)
        return hashes, runs[0], chars, ends, *windows(hashes, words, ends, min_words, runs)

    def rows_of(batch: pa.RecordBatch, ends: np.ndarray, at: np.ndarray, longs: list[np.ndarray], units: list[np.ndarray], chars: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        doc = np.searchsorted(ends, at, side="right")
        begin, rows = np.concatenate(([0], ends))[doc], pa.array(doc)
        numbers = [x.view(np.int64) for x in longs] + [(x - begin).astype(np.int32) for x in units] + [x.astype(np.int32) for x in chars]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, numbers)], schema=schema)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            hashes, prints, chars, ends, start, end, at, _ = windows_of(batch)
            at, start, end = reaches(start, end, at)
            yield rows_of(batch, ends, at, [prints[at], contents(hashes, start, end)], [at, start, end], [chars[0][start], chars[1][end]], fp_arrow)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            _, prints, chars, ends, start, end, at, content = windows_of(batch)
            found = batch.column("found")
            begin = np.concatenate(([0], ends))[:-1]
            wanted = found.flatten().to_numpy(zero_copy_only=False) + np.repeat(begin, found.value_lengths().to_numpy(zero_copy_only=False))
            k = np.flatnonzero(np.isin(at, wanted))
            yield rows_of(batch, ends, at[k], [prints[at[k]], content[k]], [start[k], end[k]], [chars[0][start[k]], chars[1][end[k]]], win_arrow)

    last = F.col(id_col).isNull().alias("none")
    place = F.struct(last, F.col(id_col).alias("id"), F.col("th").alias("th"), F.col("a").alias("a"), F.col("b").alias("b"))

    def firsts(of: DataFrame, label: str) -> DataFrame:
        # As a table, so that the join on it shuffles both sides by itself and Spark can split a frequent key.
        return written(of.groupBy("fp", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), label)

    def repeated(of: DataFrame, label: str) -> DataFrame:
        return written(of.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), label)

    other = ~(F.col(id_col).eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))
    later = other | (F.col("a") > F.col("first.b"))

    # Whole reaches first: where one occurs before, so do all windows in it, and none of them is the first of its content.
    prints = written(units.select(id_col, "th", "hashes", "sizes").mapInArrow(select, fp_schema), "prints")
    often = repeated(prints, "often")
    shared = written(prints.join(_merged(often), "fp", "left_semi"), "shared")
    discard(prints)
    discard(often)
    first = firsts(shared, "first-reaches")
    marked = written(shared.join(_merged(first), ["fp", "content"], "left").select(*shared.columns, (F.col("first").isNotNull() & later).alias("later")), "reaches")
    discard(shared)
    discard(first)
    # Then single windows, of those fingerprints that still occur more than once: mostly at the ends of what is shared.
    rest = marked.where(~F.col("later"))
    again = repeated(rest, "again")
    found = rest.join(_merged(again), "fp", "left_semi").groupBy(id_col, "th").agg(F.collect_list("pos").alias("found"))
    same = units[id_col].eqNullSafe(F.col("__id")) & (units["th"] == F.col("__th"))
    near = units.join(_merged(found.select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), "found")), same).select(id_col, "th", "hashes", "sizes", "found")
    wins = written(near.mapInArrow(extend, win_schema), "windows")
    discard(again)
    first = firsts(wins, "first")
    span = [id_col, "th", "a", "b", "x", "y"]
    both = marked.where("later").select(span).union(wins.join(_merged(first), ["fp", "content"]).where(later).select(span))
    spans = both.groupBy(id_col, "th").agg(F.collect_set(F.struct("a", "b", "x", "y")).alias("spans"))
    return spans, (units, marked, wins, first)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`df` with its texts shortened, and n_deleted and cut: the number of units deleted, and the character ranges cut out

    (array<struct<a, b>>, b exclusive, null where there are none). Columns of `df` with these names are replaced.
    """
    spans, read = repeated_spans(df, id_col, text_col, min_words)
    cut_schema = "cut array<struct<a:int,b:int>>, kept array<struct<a:int,n:int>>, n_deleted int"
    out = StructType([df.schema[id_col], *_parse_datatype_string("th long, " + cut_schema).fields])

    def cuts(batches):
        import pandas as pd

        for pdf in batches:
            made = []
            for ranges in pdf["spans"]:
                a, b, x, y = (np.array([r[k] for r in ranges]) for k in ("a", "b", "x", "y"))
                order = np.argsort(a, kind="stable")
                a, b, x, y = a[order], np.maximum.accumulate(b[order]), x[order], np.maximum.accumulate(y[order])
                turn = np.flatnonzero(a[1:] > b[:-1] + 1)  # a run ends here, the next starts after it
                head, tail = np.r_[0, turn + 1], np.r_[turn, len(a) - 1]
                cut = list(zip(x[head].tolist(), y[tail].tolist(), strict=True))
                edges = [0, *(v for c in cut for v in c), WHOLE]
                kept = [(p, q - p) for p, q in zip(edges[::2], edges[1::2], strict=True) if q > p]
                made.append(([{"a": p, "b": q} for p, q in cut], [{"a": p, "n": n} for p, n in kept], int((b[tail] - a[head] + 1).sum())))
            cols = list(zip(*made, strict=True)) if made else [[]] * 3
            yield pd.DataFrame({id_col: pdf[id_col], "th": pdf["th"], "cut": cols[0], "kept": cols[1], "n_deleted": cols[2]})

    table = spans.mapInPandas(cuts, out).select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), "cut", F.col("kept").alias("__kept"), F.col("n_deleted").alias("__deleted"))
    table = written(table, "cuts")  # one row for each id and text: repeated rows share it
    for done in read:
        discard(done)
    docs = df.select(*(c for c in df.columns if c not in ("n_deleted", "cut")))
    joined = docs.join(_merged(table), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__th")), "left")
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.concat_ws("", F.transform("__kept", lambda k: F.substring(F.col(text_col), k["a"] + 1, k["n"]))))
    rest = [text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*rest, F.coalesce("__deleted", F.lit(0)).alias("n_deleted"), F.col("cut"))
