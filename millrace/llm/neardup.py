"""Near-duplicates at a similarity: SimHash links first, then what they can't see, each verified by its exact Jaccard similarity.

A text's set holds the hashes of its runs of `words` words (of the whole sequence where it is shorter). Links of `simhash`
(fingerprints that share pigeonhole blocks and lie within `distance` bits) are verified first; they connect copies and close
copies. At a similarity of 0.8 two fingerprints of 64 bits differ in about ten bits, and blocks that hold for ten bits have
no key left to join on, so the other pairs come from sampled minima: each of `BANDS` keys combines `ROWS` minima of the set
under different permutations, and texts that share a key and are still apart are candidates. Two sets of similarity 0.8 share
none of 32 keys of 4 minima with a chance of 5e-8; a pair that is verified is never wrong.

Links are needed only as far as they connect, so a bucket is never paired with itself. Its first `LEADS` texts are checked
against all of it, which connects a cluster of close copies however large. What is then still apart, texts that share much
without being similar (boilerplate), gets other keys, exact ones: of a text's set, in order of how rare its hashes are among
these texts, the first n - ceil(0.8 n) + 1; two sets of similarity 0.8 have one of them in common, and what many texts share
comes last. These buckets meet leads in turn, four times as many in each round (`MOST_LEADS` at most), until every one is
one group or all its texts have been leads. A check is spared where two texts are connected already, their sizes alone rule
out the similarity, or an earlier bucket has made it. A round writes at most its leads times the texts left; nothing is
dropped. A lead's set is sent once for each `BLOCK` texts that it meets, not once for each.

Nulls and edges: a null text counts as empty; texts without words have the same, empty set and are one group; repeated
rows and null ids as in `simhash`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import discard, over_texts, written
from .simhash import components, majority, named, shingle_hashes, stay

BANDS, ROWS = 32, 4
#: Texts of a bucket that all others are checked against: in the first round, and at most in a later one.
LEADS, MOST_LEADS = 2, 512
#: Texts that one copy of a lead's set is checked against.
BLOCK = 256
#: Hashes that are permuted at once.
CHUNK = 2048
_DRAW = np.random.default_rng(42)
_TIMES, _MIX = (_DRAW.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLUS = _DRAW.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The `BANDS` keys of a set; the number of the band goes into its key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), CHUNK):
        np.minimum(least, (_TIMES.reshape(-1, 1) * hashes[a : a + CHUNK]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _PLUS


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp, sim, n, keys): for each row a hash of its text, its SimHash fingerprint, the size of its set and the keys."""

    def rows(texts: list[str | None]) -> dict:
        runs = [shingle_hashes(t, words) for t in texts]
        sets = [np.unique(r) for r in runs]
        return {"sim": majority(runs).view(np.int64), "n": [len(s) for s in sets], "keys": [keys_of(s).view(np.int64) for s in sets]}

    return over_texts(_texts(df, id_col, text_col), [id_col, "fp"], "__text", "sim long, n long, keys array<long>", rows)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return df.select(id_col, F.xxhash64(text).alias("fp"), text.alias("__text"))


def sets_of(texts: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """(fp, set): the hashes of the runs of words of the texts that `ends` (fp) names, once each, as a table."""

    def rows(found: list[str | None]) -> dict:
        return {"set": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in found]}

    own = texts.join(ends.select("fp").distinct(), "fp", "left_semi").select("fp", "__text").dropDuplicates(["fp"])
    return written(over_texts(own, ["fp"], "__text", "set array<long>", rows), "sets")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of `pairs` whose texts' sets have a Jaccard similarity of `percent` % at least."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b", F.lit(9)), "blocks"))
    ours = dealt.select("a", "block").distinct().join(sets.toDF("a", "x"), "a")
    theirs = dealt.select("a", "block", "b").join(sets.toDF("b", "y"), "b")
    both = theirs.join(ours.hint("merge"), ["a", "block"])
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(F.col("common") * (100 + percent) >= F.col("total") * percent).select("a", "b")


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(fp, n, key): of each set the hashes that one of every similar set must have too, without those no other set has."""
    each = sets.select("fp", F.size("set").cast("long").alias("n"), F.explode("set").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c"))
    by_rarity = Window.partitionBy("fp").orderBy("c", "key")
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    ranked = each.join(often, "key").withColumn("at", F.row_number().over(by_rarity))
    return ranked.where((F.col("at") <= first) & (F.col("c") > 1)).select("fp", "n", "key")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): texts (fp, sim) of one fingerprint, each with the smallest of them, and those of linked fingerprints."""
    least = written(nodes.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprints")
    same = nodes.join(least, "sim").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    near = simhash.links(least.select(F.col("sim").alias("fp")), distance)
    of = lambda side, name: least.select(F.col("sim").alias(side), F.col("least").alias(name))
    return _ends(same.union(near.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")))


def links(prints: DataFrame, texts: DataFrame, words: int, percent: int, distance: int = 4) -> DataFrame:
    """(a, b): verified links between the hashes of texts that connect all that candidates connect."""
    nodes = written(prints.groupBy("fp").agg(F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    close = written(simhash_pairs(nodes.select("fp", "sim"), distance), "pairs")
    known = lambda pairs: sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("fp")), words)
    found = written(similar(close, known(close), percent), "links")

    groups = components(found)

    def rooted(of: DataFrame) -> DataFrame:
        """With the group (root) that the links so far give each text."""
        return of.join(groups, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")

    def apart(of: DataFrame) -> DataFrame:
        """The rows whose key joins several groups."""
        several = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return written(of.join(several.hint("merge"), "key", "left_semi"), "apart")

    sets = None
    rest, tried, leads = apart(rooted(nodes).select("fp", "n", "root", F.explode("keys").alias("key"))), close, LEADS
    discard(nodes)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    while not rest.isEmpty():
        # A window limit: of a frequent key each task sends its first `leads` texts alone.
        at = F.row_number().over(Window.partitionBy("key").orderBy("fp"))
        heads = written(rest.withColumn("at", at).where(F.col("at") <= leads).drop("at"), "heads")
        a, b = (of.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "n", "root"))) for s, of in (("a", heads), ("b", rest)))
        met = a.join(b, "key").where((F.col("fp_a") < F.col("fp_b")) & (F.col("root_a") != F.col("root_b")) & sized)
        pairs = _ends(met.select(F.col("fp_a").alias("x"), F.col("fp_b").alias("y")))
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            tried = tried.union(pairs)
            found = written(found.union(similar(pairs, known(pairs) if sets is None else sets, percent)), "links")
            groups = components(found)
        # Leads have met all texts of their keys; those after them may still be apart from each other.
        done = heads.groupBy("key").agg(F.max("fp").alias("done"))
        after = rest.join(done.hint("merge"), "key").where("fp > done").select("fp", "n", "key")
        before, rest = rest, apart(rooted(after))
        if sets is None:  # from now on by exact keys
            sets = sets_of(texts, rest, words)
            discard(rest)
            rest = apart(rooted(rare_keys(sets, percent)))
        else:
            leads = min(4 * leads, MOST_LEADS)
        discard(before)
        discard(heads)
    return found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, fp, component_id): for each row a hash of its text and the smallest id that it reaches through links."""
    prints = written(sketches(df, id_col, text_col, words), "sketches")
    edges = links(prints, _texts(df, id_col, text_col), words, percent)
    return named(prints.select(id_col, "fp"), edges, id_col)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `df` that stay, as `simhash.representatives` says."""
    return stay(df, near_duplicates(df, id_col, text_col, words, percent), id_col)
