"""SimHash near-duplicates: fingerprints from word shingles, links through pigeonhole blocks, components.

Fingerprints at most `distance` bits apart share at least `m - distance` of `m` equal blocks. Each fingerprint is
therefore keyed by every combination of `m - distance` blocks; rows are joined on these keys and each pair that meets
is verified by its Hamming distance. More blocks give longer keys (fewer chance meetings) but more of them; `m` follows
from the number of distinct fingerprints alone, and buckets that are still large are keyed anew with more blocks.
With 16 blocks and distance 4 a bucket shares 48 of 64 bits, so it has at most 65,536 distinct fingerprints.

Nulls and edges: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other;
rows that repeat are kept, each with its fingerprint; an empty table gives an empty result. A null id is kept as a
node without a name: its component is named by the smallest id that is not null, and is null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, over_texts, written

#: The hash function's seed, as the contract fixes it.
SEED = 42
#: (blocks, largest bucket before the next level takes over); the last level is bounded by arithmetic.
LEVELS = (6, 7, 8, 10, 12, 16)
LARGE_BUCKET = 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence where it is shorter."""
    # bytes.split() and bytes.lower() know ASCII alone: [\\x20\\x09-\\x0D] and A-Z.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes: a bit is 1 if it is set in over half of them."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    ones = np.zeros((len(hashes), 64), np.int64)
    flat = np.concatenate(hashes) if len(hashes) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for a in range(0, len(flat), 1 << 16):
        part, of = flat[a : a + (1 << 16)], owner[a : a + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_ = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, fp long): one row for each row of `df`; fp holds the 64 bits as a signed long."""

    def rows(texts: list[str | None]) -> dict:
        return {"fp": majority([shingle_hashes(t, words) for t in texts]).view(np.int64)}

    return over_texts(df, [id_col], text_col, "fp long", rows)


def block_masks(m: int, distance: int) -> list[int]:
    """A mask for each combination of `m - distance` of `m` blocks of 64 bits."""
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(m)]
    return [sum(blocks[k] for k in c) for c in combinations(range(m), m - distance)]


def level_for(n: int, distance: int) -> int:
    """The first level whose keys are long enough to make chance meetings fewer than the fingerprints."""
    for k, m in enumerate(LEVELS):
        if m > distance and 64 * (m - distance) // m >= max(1, n).bit_length() + comb(m, distance).bit_length() - 4:
            return k
    return len(LEVELS) - 1


def _links_in_bucket(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket: never more rows than fingerprints."""
    group = np.arange(len(x))
    left, right = [], []

    def join(i: int, js: np.ndarray) -> None:
        for g, first in zip(*np.unique(group[js], return_index=True), strict=True):
            if g != group[i]:
                left.append(x[i])
                right.append(x[js[first]])
                group[group == g] = group[i]

    todo = np.ones(len(x), bool)
    leaders = []
    while todo.any():  # leaders: all that is near one of them is linked through it
        i = int(np.argmax(todo))
        near = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= distance)
        join(i, near)
        todo[near] = False
        leaders.append(i)
    if len(np.unique(group)) > 1:  # what is left: links between groups that don't touch a leader
        for i in range(len(x)):
            others = np.flatnonzero(group != group[i])
            if len(others):
                near = others[np.bitwise_count(x[others] ^ x[i]) <= distance]
                if len(near):
                    join(i, near)
            else:
                break
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _link_batches(distance: int):
    """For mapInArrow over (key, fp), sorted by key: verified links (a, b). A bucket may span batches."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        a, b = [], []
        wide = np.repeat(sizes, sizes)
        for d in range(1, 16):  # small buckets: all at once, pairs by their offset
            if d >= len(x):
                break
            ok = (keys[d:] == keys[:-d]) & (wide[d:] <= 16)
            i = np.flatnonzero(ok)
            if not len(i):
                break
            i = i[np.bitwise_count(x[i] ^ x[i + d]) <= distance]
            a.append(x[i])
            b.append(x[i + d])
        for k in np.flatnonzero(sizes > 16):
            p, q = _links_in_bucket(x[first[k] : first[k] + sizes[k]], distance)
            a.append(p)
            b.append(q)
        a, b = (np.concatenate(v) if v else np.empty(0, np.uint64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, x = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)], axis=1).astype(np.int64)
            keys = np.concatenate((keys, k))
            x = np.concatenate((x, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(x) < 100_000:
                continue
            open_ = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = open_[-1] + 1 if len(open_) else 0  # the last bucket may go on
            if cut:
                yield emit(_runs(keys[:cut]), x[:cut])
                keys, x = keys[cut:], x[cut:]
        if len(x):
            yield emit(_runs(keys), x)

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between the distinct fingerprints of `nodes` (fp long, no repeats) that connect all that lie within `distance` bits."""
    found = []
    level = level_for(nodes.count(), distance)
    rest = nodes.select("fp")
    while True:
        masks = block_masks(LEVELS[level], distance)
        keyed = rest.select(
            "fp",
            F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks))).alias("mask", "key"),
        )
        last = level == len(LEVELS) - 1
        if last:
            small = keyed
        else:
            large = written(keyed.groupBy("mask", "key").count().where(F.col("count") > LARGE_BUCKET).select("mask", "key"), "buckets")
            any_large = not large.isEmpty()
            small = keyed.join(large, ["mask", "key"], "left_anti") if any_large else keyed
        small = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found.append(written(small.mapInArrow(_link_batches(distance), "a long, b long").where("a <> b"), "links"))
        if last or not any_large:
            break
        rest = written(keyed.join(large, ["mask", "key"], "left_semi").select("fp").distinct(), "large")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of an edge (a, b) reaches, by alternating large and small stars.

    Each round writes its edges, so that lineage stays short and a lost executor costs one round.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:  # every neighbour above the node goes to the smallest of all neighbours
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        else:  # every neighbour below it, and the node itself, go to the smallest of them
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            out = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), F.col("m").alias("y"))
        return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    now = written(edges, "edges")
    seen = mark(now)
    while seen[0]:
        new = written(star(star(now, True), False), "edges")
        discard(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def named(prints: DataFrame, edges: DataFrame, id_col: str, nodes: DataFrame | None = None) -> DataFrame:
    """(id, fp, component_id) for rows (id, fp) and links (a, b) between values of fp."""
    if nodes is None:
        nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(edges)
    known = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = known.join(names, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(id_col, "fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 4) -> DataFrame:
    """(id, fp, component_id): for each row its fingerprint and the smallest id that it reaches through links."""
    prints = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    return named(prints, links(nodes, distance), id_col, nodes)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 4) -> DataFrame:
    """The rows of `df` that stay: of each group the one with the smallest id (one of them where that id repeats).

    Rows with a null id are in no group that has a name: of those only groups without any id keep one row.
    """
    return stay(df, near_duplicates(df, id_col, text_col, words, distance), id_col)


def stay(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of `df` whose id names their group in `found`."""
    ids = written(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("__stay")).count(), "stay")
    out = df.join(ids.hint("merge"), df[id_col].eqNullSafe(F.col("__stay")), "left_semi")
    return out if ids.where("count > 1").isEmpty() else out.dropDuplicates([id_col])
