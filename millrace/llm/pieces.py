"""SentencePiece BPE encoding and decoding with numpy: merge rounds over flat symbol arrays.

The model file is read here (its protocol buffer has a public layout); the library itself is only needed in tests.
Words (a run of spaces and what follows it; the model has no piece across such a border) of a step are made distinct
and laid end to end as symbols. Each round finds the best pair of every word by a segmented minimum, merges its
occurrences from the left at once, and compacts the arrays, until no word has a pair. A merge that makes a pair as good
as the current one ends its word's round, so that the order is exactly the library's: best score first, then leftmost.
Where that happens to a word of more than `LONG_WORD` symbols (runs of spaces, whose pieces all have one score, would take
a round each merge), one pass from the left does all the merges of its round's score in that very order.

Nulls and edges: a null text counts as empty and gives the end id alone; characters the model lacks become byte pieces;
texts and words of any length are handled whole; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import over_texts

SPACE = "▁"
#: Words kept between steps, and the longest word kept.
CACHE_WORDS, CACHE_LENGTH = 300_000, 48
NONE = np.int64(1 << 40)
#: Symbols of a word from which on a round that would end early is done in one pass from the left.
LONG_WORD = 32
#: Piece types of the model's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[str]
    kinds: np.ndarray
    pair_keys: np.ndarray  # sorted; left id * width + right id
    pair_merged: np.ndarray  # the piece each pair makes
    rank: np.ndarray  # by piece, 0 for the best score
    char_ids: dict[str, int]
    byte_ids: np.ndarray
    end_id: int
    dummy_prefix: bool

    def __post_init__(self):
        self.cache: dict[str, str] = {}
        self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_merged.tolist(), strict=True))
        self.ranks = self.rank.tolist()
        kinds = self.kinds.tolist()
        self.surface = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]


def load_model(data: bytes) -> Model:
    """Parses a model file; only BPE models with byte fallback and without text normalisation are known here."""
    pieces, scores, kinds, spec = [], [], [], {"dummy": True, "squeeze": True, "map": b"", "type": 1, "bytes": 0, "end": 2}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f[1].decode())
            scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(_fields(value))
            spec |= {"type": f.get(3, 1), "bytes": f.get(35, 0), "end": f.get(42, 2)}
        elif number == 3:
            f = dict(_fields(value))
            spec |= {"map": f.get(2, b""), "dummy": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1))}
    if spec["type"] != 2 or not spec["bytes"] or spec["map"] or spec["squeeze"] or USER_DEFINED in kinds or UNUSED in kinds:
        raise ValueError("this model's kind or normalisation is not supported")
    if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
        raise ValueError("this model has pieces across words")
    kinds_ = np.array(kinds)
    ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
    rank = np.full(len(pieces), NONE)
    normal = np.flatnonzero(kinds_ == NORMAL)
    rank[normal] = np.unique(-np.array(scores)[normal], return_inverse=True)[1]
    chars = {p: i for p, i in ids.items() if len(p) == 1}
    for p in ids:  # characters that only occur inside pieces still take part in merges
        for c in p:
            chars.setdefault(c, len(pieces) + len(chars))
    width = len(pieces) + len(chars) + 1
    known = {**{c: i for c, i in chars.items()}, **ids}
    pairs = [(known[p[:k]] * width + known[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
    pairs.sort()
    keys, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    by_byte = sorted((int(p[3:5], 16), i) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE)
    model = Model(pieces, kinds_, keys, merged, rank, chars, np.array([i for _, i in by_byte]), spec["end"], spec["dummy"])
    model.width = width
    # An open-addressed table: two probes on average instead of a binary search's seventeen.
    bits = int(np.ceil(np.log2(len(keys)))) + 2
    table = np.full(1 << bits, -1, np.int64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    home = ((keys.astype(np.uint64) * mul) >> np.uint64(64 - bits)).astype(np.int64)
    todo, probe = np.arange(len(keys)), home.copy()
    while len(todo):
        free = table[probe[todo]] < 0
        table[probe[todo[free]]] = todo[free]
        todo = todo[table[probe[todo]] != todo]
        probe[todo] = (probe[todo] + 1) & ((1 << bits) - 1)
    model.table, model.bits, model.mul = table, bits, mul
    return model


def _merged(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The piece that each pair makes, -1 for none."""
    key = left * model.width + right
    probe = ((key.astype(np.uint64) * model.mul) >> np.uint64(64 - model.bits)).astype(np.int64)
    out = np.full(len(key), -1, np.int64)
    todo = np.arange(len(key))
    while len(todo):
        slot = model.table[probe[todo]]
        todo, slot = todo[slot >= 0], slot[slot >= 0]
        hit = model.pair_keys[slot] == key[todo]
        out[todo[hit]] = model.pair_merged[slot[hit]]
        todo = todo[~hit]
        probe[todo] = (probe[todo] + 1) & ((1 << model.bits) - 1)
    return out


def leftmost_pass(model: Model, symbols: list[int], level: int) -> tuple[list[int], list[int]]:
    """All merges with ranks up to `level`, the best of the word's pairs, and where each symbol left began.

    What is done has no pair of `level` or better left, so the next merge is at its end or, where none is there, further on:
    best rank first, then leftmost, as the library has it.
    """
    get, rank, width, worse = model.pairs.get, model.ranks, model.width, level + 1

    def made(left: int, right: int) -> tuple[int, int]:
        piece = get(left * width + right) if left >= 0 and right >= 0 else None
        return (worse, -1) if piece is None else (rank[piece], piece)

    done, begins, k, n = [], [], 0, len(symbols)
    while k < n:
        top, begin = symbols[k], k
        k += 1
        while True:
            before, left = made(done[-1], top) if done else (worse, -1)
            after, right = made(top, symbols[k]) if k < n else (worse, -1)
            if before <= level and before <= after:
                done.pop()
                top, begin = left, begins.pop()
            elif after <= level:
                top, k = right, k + 1
            else:
                break
        done.append(top)
        begins.append(begin)
    return done, begins


def merge_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the ids of all words end to end, and how many each word has. Words are not empty."""
    text = "".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    distinct, inverse = np.unique(codes, return_inverse=True)
    lookup = np.array([model.char_ids.get(chr(c), -1 - int(c)) for c in distinct], np.int64)
    symbols = lookup[inverse]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner, done_place = [], [], []
    place = np.arange(len(symbols))
    # A character without an id never merges; its code is kept as a negative number until the end.
    makes = np.full(len(symbols), -1, np.int64)
    if len(symbols) > 1:
        pair = (owner[1:] == owner[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0)
        k = np.flatnonzero(pair)
        makes[k] = _merged(model, symbols[k], symbols[k + 1])
    while len(symbols):
        cost = np.where(makes >= 0, model.rank[makes], NONE)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[first, len(symbols)])
        best = np.minimum.reduceat(cost, first)
        alive = np.repeat(best < NONE, sizes)
        if not alive.all():
            done_symbols.append(symbols[~alive])
            done_owner.append(owner[~alive])
            done_place.append(place[~alive])
            symbols, owner, place, makes, cost = symbols[alive], owner[alive], place[alive], makes[alive], cost[alive]
            sizes, best = sizes[best < NONE], best[best < NONE]
            if not len(symbols):
                break
        n = len(symbols)
        at = np.flatnonzero(cost == np.repeat(best, sizes))
        # Runs of overlapping occurrences: every other one from the left is taken.
        if len(at) > 1:
            start = np.r_[True, np.diff(at) > 1]
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        new = makes[at]
        level = cost[at]
        # The pairs that the new symbol makes with its neighbours, left merged already and right not yet.
        kept = np.ones(n, bool)
        kept[at + 1] = False
        after = symbols.copy()
        after[at] = new
        previous = at - 1
        previous = np.where((previous >= 0) & ~kept[np.maximum(previous, 0)], previous - 1, previous)
        has_left = (previous >= 0) & (owner[np.maximum(previous, 0)] == owner[at])
        following = at + 2
        has_right = (following < n) & (owner[np.minimum(following, n - 1)] == owner[at])
        left_id, right_id = after[np.maximum(previous, 0)], symbols[np.minimum(following, n - 1)]
        left_makes, right_makes = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int64)
        k = np.flatnonzero(has_left & (left_id >= 0))
        left_makes[k] = _merged(model, left_id[k], new[k])
        k = np.flatnonzero(has_right & (right_id >= 0))
        right_makes[k] = _merged(model, new[k], right_id[k])
        early = ((left_makes >= 0) & (model.rank[left_makes] <= level)) | ((right_makes >= 0) & (model.rank[right_makes] <= level))
        if early.any():  # such a word goes no further in this round
            w = owner[at]
            begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            so_far = np.cumsum(early) - early
            base = np.repeat(so_far[begin], np.diff(np.r_[begin, len(w)]))
            ok = so_far == base
            long = np.unique(w[early & (np.repeat(sizes, sizes)[at] > LONG_WORD)])
            ok &= ~np.isin(w, long)
            at, new, previous, has_left = at[ok], new[ok], previous[ok], has_left[ok]
            left_makes, right_makes, has_right = left_makes[ok], right_makes[ok], has_right[ok]
            kept = np.ones(n, bool)
            kept[at + 1] = False
            edges = np.r_[0, np.cumsum(sizes)]
            words_here = owner[edges[:-1]]
            for k in np.searchsorted(words_here, long).tolist():
                a, b = int(edges[k]), int(edges[k + 1])
                passed, begins = leftmost_pass(model, symbols[a:b].tolist(), int(best[k]))
                kept[a:b] = False
                where = a + np.array(begins)
                kept[where] = True
                symbols[where] = passed
                makes[where] = -1
                pair = np.flatnonzero((symbols[where[:-1]] >= 0) & (symbols[where[1:]] >= 0))
                makes[where[pair]] = _merged(model, symbols[where[pair]], symbols[where[pair + 1]])
        symbols[at] = new
        makes[at] = right_makes
        k = np.flatnonzero(has_left)
        makes[previous[k]] = left_makes[k]
        # Where the right neighbour merged too, the pair with its new symbol was set as that one's left pair.
        symbols, owner, place, makes = symbols[kept], owner[kept], place[kept], makes[kept]
    symbols, owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_symbols, done_owner, done_place))
    order = np.argsort(place, kind="stable")
    symbols, owner = symbols[order], owner[order]
    lacking = np.flatnonzero((symbols < 0) | (symbols >= len(model.pieces)))
    if len(lacking):  # to UTF-8 bytes
        names = {i: c for c, i in model.char_ids.items() if i >= len(model.pieces)}
        raw = [(names[int(s)] if s >= 0 else chr(-1 - int(s))).encode("utf-8", "surrogatepass") for s in symbols[lacking]]
        counts = np.ones(len(symbols), np.int64)
        counts[lacking] = [len(r) for r in raw]
        owner = np.repeat(owner, counts)
        spread = np.repeat(symbols, counts)
        ends = np.cumsum(counts)
        where = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in lacking])
        spread[where] = model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        symbols = spread
    return symbols, np.bincount(owner, minlength=len(words))


def _words(model: Model, text: str) -> list[str]:
    """The text's words, each a run of spaces and what follows it."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if model.dummy_prefix:
        text = " " + text
    if "  " in text or text[-1] == " " or text[0] != " ":
        return [w.replace(" ", SPACE) for w in re.findall(r"^[^ ]+| +[^ ]*", text)]
    return [SPACE + w for w in text[1:].split(" ")]


def encode_texts(model: Model, texts: list[str | None]) -> list[list[str]]:
    """For each text its words' ids, a string of decimal ids joined by a space for each word."""
    cache = model.cache
    words = [_words(model, t or "") for t in texts]
    new = list({w for ws in words for w in ws} - cache.keys())
    long: dict[str, str] = {}
    for a in range(0, len(new), 50_000):
        part = new[a : a + 50_000]
        ids, sizes = merge_words(model, part)
        named = list(map(str, ids.tolist()))
        ends = np.cumsum(sizes).tolist()
        for w, i, j in zip(part, [0, *ends], ends, strict=False):
            (cache if len(w) <= CACHE_LENGTH else long)[w] = " ".join(named[i:j])
    get = cache.__getitem__ if not long else lambda w: cache[w] if w in cache else long[w]
    out = [list(map(get, ws)) for ws in words]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    return out


def decode_ids(model: Model, ids: list[int]) -> str:
    """The text of ids, as the library's decode gives it: no control pieces, no space that the prefix added."""
    surface = model.surface
    out = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
    first = next((i for i in ids if model.kinds[i] != CONTROL), None)
    return out[1:] if model.dummy_prefix and first is not None and model.kinds[first] == NORMAL and out[:1] == " " else out


def encode(df: DataFrame, model_file: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """For each row: id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids themselves; an end id is added."""
    shared = df.sparkSession.sparkContext.broadcast(model_file)

    def rows(texts: list[str | None]) -> dict:
        model = _model(shared.value)
        n, ids_sha, decoded_sha, ids = [], [], [], []
        for words in encode_texts(model, texts):
            joined = " ".join([*words, str(model.end_id)])
            own = list(map(int, joined.split(" ")))
            n.append(len(own))
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decode_ids(model, own).encode("utf-8", "surrogatepass")).hexdigest())
            if with_ids:
                ids.append(own)
        return {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "ids": ids}

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return over_texts(df, [id_col], text_col, schema, rows)


_MODELS: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS[key] = load_model(data)
    return _MODELS[key]
