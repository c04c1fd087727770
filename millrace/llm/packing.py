"""Packing of documents into windows by the online sum-of-squares rule.

A document becomes its token ids and an end id. Full windows are cut off its front; the rest, shorter than a window,
goes to the fill level that makes the sum of squared counts of partially filled windows least. The counts live in a
level array: entry h holds how many open windows are filled to h. Each partition packs by itself, so there is no
shuffle and no state that grows with the table; sequence ids carry the partition's number in their upper bits.

When a partition ends, its fullest open windows stay as they are, padded, as long as all their padding is at most a share
`padding` of the partition's ids. Of the others as many as their ids can fill stay too, and the emptiest are dissolved:
their ids fill the gaps of those that stay (documents may be cut freely), and what is left over goes to windows of powers
of two, lengths that need no padding. Whatever the rule has placed in a window that stays keeps its place.

Nulls and edges: a null or empty text is one token, the end id; a null doc_id is kept; repeated rows are packed each;
texts of any length are cut into as many windows as they need; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import steps

WINDOW = 2048
END_ID = 1
#: The tokenizer's added tokens: their literals are one id wherever they stand, before any other rule.
ADDED = {"<|endoftext|>": 50256}
#: The padding that open windows may keep when a partition ends, as a share of the partition's ids.
PADDING = 1 / 200
_ENCODERS: dict = {}


def encoder(ranks_file: bytes, pattern: str):
    """A function text -> uint32 ids for a byte-level rank file and `ADDED`; one encoder for each worker and file."""
    key = (zlib.crc32(ranks_file), pattern)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
    made = _ENCODERS[key]

    def encode(text: str) -> np.ndarray:
        ids: list[int] = []
        for part in _ADDED.split(text) if any(t in text for t in ADDED) else [text]:
            if part in ADDED:
                ids.append(ADDED[part])
                continue
            done = 0
            for a, b in long_spaces(part):
                # The pattern takes a run of white space up to its last character, which may go with what follows.
                b -= b < len(part)
                ids += made.encode_ordinary(part[done:a])
                ids += made._encode_single_piece(part[a:b].encode())
                done = b
            ids += made.encode_ordinary(part[done:] if done else part)
        return np.array(ids, np.uint32)

    return encode


#: White space as the tokenizer's pattern has it.
_SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN, _ADDED = re.compile(f"[{_SPACES}]+"), re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")
#: Every run of white space this long is cut out before encoding: the pattern's search overflows on some 10^6 characters.
LONG_SPACE = 4096


def long_spaces(text: str) -> list[tuple[int, int]]:
    """Runs of white space, among them all with `LONG_SPACE` characters or more: one in so many characters is looked at."""
    runs, end = [], 0
    for k in range(LONG_SPACE - 1, len(text), LONG_SPACE):
        if k >= end and text[k] in _SPACES:
            low = max(end, k - LONG_SPACE + 1)
            start = low + len(text[low:k].rstrip(_SPACES))
            end = _RUN.match(text, k).end()
            if end - start >= LONG_SPACE:
                runs.append((start, end))
    return runs


class Packer:
    """Places pieces in windows; `put` gives (window number, offset)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)  # open windows by fill; entries 0 and `size` stay 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.next = self.placed = 0  # windows opened, ids placed

    def put(self, n: int) -> tuple[int, int]:
        """Window and offset for a piece of n ids, 1 <= n <= size; ties go to the fullest level."""
        self.placed += n
        if n < self.size:
            # Moving a window from h to h + n changes the sum of squares by 2 (N[h + n] - N[h]) + 2; filling it up
            # changes it by 1 - 2 N[h]; a new window by 2 N[n] + 1.
            h = self.levels[1 : self.size - n + 1]
            change = 2 * (self.levels[n + 1 : self.size + 1] - h) + 2
            change[-1] -= 1
            change[h == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * self.levels[n] + 1:
                level = best + 1
                window = self.open[level].pop()
                self.levels[level] -= 1
                self._file(window, level + n)
                return window, level
        window, self.next = self.next, self.next + 1
        self._file(window, n)
        return window, 0

    def _file(self, window: int, fill: int) -> None:
        if fill < self.size:
            self.open[fill].append(window)
            self.levels[fill] += 1

    def left_open(self) -> dict[int, int]:
        return {w: fill for fill, ws in enumerate(self.open) for w in ws}


def pack(df: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, end_id: int = END_ID, padding: float = PADDING, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((ranks_file, pattern))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = StructType([df.schema[id_col], *(StructField(n, LongType()) for n in names)])
    if with_ids:
        out = out.add("ids", ArrayType(IntegerType()))

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*shared.value)
        base = TaskContext.get().partitionId() << 40
        packer, end = Packer(size), np.array([end_id], np.uint32)
        held: dict[int, list] = {}  # pieces of open windows; they may yet be moved

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            arrays = [pa.array(cols[0], arrow.field(0).type)]
            arrays += [pa.array(c, pa.int64()) for c in cols[1:3]]
            arrays += [pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in cols[7]], pa.int64())]
            arrays += [pa.array(cols[3], pa.int64()), pa.array([base + s for s in cols[4]], pa.int64()), pa.array(cols[5], pa.int64())]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(ids) for ids in cols[7]], dtype=np.int64))).astype(np.int32)
                flat = np.concatenate(cols[7]) if cols[7] else np.empty(0)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))).cast(arrow.field("ids").type))
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(texts):
                done = []
                for key, text in zip(keys[a:b], texts[a:b], strict=True):
                    ids = np.concatenate((encode(text), end)) if text else end
                    total = len(ids)
                    for start in range(0, total, size):
                        piece = ids[start : start + size]
                        window, offset = packer.put(len(piece))
                        row = (key, start, len(piece), total, window, offset, None, piece)
                        pieces = held.setdefault(window, [])
                        pieces.append(row)
                        if offset + len(piece) == size:
                            done += held.pop(window)
                yield made(done)
        stay, fill = closing(packer.left_open(), packer.placed * padding, size)
        yield made([row for w in stay for row in held[w]])
        yield made(refill([row for w in sorted(fill[1]) for row in held[w]], fill[0], packer.next, size))

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def closing(fills: dict[int, int], padding: float, size: int) -> tuple[list[int], tuple[list[tuple[int, int]], list[int]]]:
    """Of open windows, by number: those that stay; of these, those to be filled up (number, fill); and those to dissolve."""
    order = sorted(fills, key=lambda w: (-fills[w], w))
    padded = 0
    while padded < len(order) and size - fills[order[padded]] <= padding:
        padding -= size - fills[order[padded]]
        padded += 1
    filled = padded + sum(fills[w] for w in order[padded:]) // size
    # Large gaps first: the last pieces are then the small ones.
    return order[:filled], ([(w, fills[w]) for w in reversed(order[padded:filled])], order[filled:])


def refill(loose: list[tuple], gaps: list[tuple[int, int]], window: int, size: int) -> list[tuple]:
    """Lays pieces end to end in the gaps of windows (number, fill), then in new windows whose lengths are powers of two."""
    left = sum(row[2] for row in loose) - sum(size - fill for _, fill in gaps)
    places = [(w, fill, size - fill) for w, fill in gaps]
    for bit in reversed(range(max(left, 0).bit_length())):
        if left >> bit & 1:
            places.append((window, 0, 1 << bit))
            window += 1
    rows, k, used = [], 0, 0
    for key, start, length, total, _, _, _, ids in loose:
        at = 0
        while at < length:
            w, fill, room = places[k]
            n = min(room - used, length - at)
            rows.append((key, start + at, n, total, w, fill + used, None, ids[at : at + n]))
            at, used = at + n, used + n
            if used == room:
                k, used = k + 1, 0
    return rows
