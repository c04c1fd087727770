"""Passages that texts share with a table of items: for each pair the longest run of words both have, exactly.

An inverted index over hashes of n words finds where they meet. A run of `least` words holds `least - n + 1` of them side
by side, so of each such window of an item only its rarest needs to be looked up, rarity being its count among all texts; a
window with one that no text has is dropped. What meets so is verified word by word along its diagonal. Frequent n-grams
are looked up only where a window has nothing rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.session import table
from millrace.sources.formats import scratch

N_WORDS, LEAST = 8, 20
#: Bits of the filter that texts' hashes pass before they are shuffled: its size does not follow the items' number.
FILTER_BITS = 24
STEP_CHARS = 4_000_000


def words(text: Column) -> Column:
    """A-Z lower-cased, cut at spaces and the characters 9 to 13; null counts as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(text: str | None, n: int, known: _Hashes) -> np.ndarray:
    """A hash for each n words of the text, in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() takes A-Z alone
    if len(found) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    factor, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(out) + k]) * factor
        out ^= out >> np.uint64(29)
    return out


def grams(df: DataFrame, id_col: str, text_col: str, n: int, passes: np.ndarray | None = None) -> DataFrame:
    """id, at, h: the hashes of all n words of all texts; with `passes`, a filter by their upper bits, of those only."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(passes) if passes is not None else None
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            # Texts one by one from Arrow, rows in steps of bounded size.
            ids, ats, hs, held = [], [], [], 0
            for k in range(len(batch)):
                h = gram_hashes(batch.column(1)[k].as_py(), n, known)
                at = np.arange(len(h))
                if shared is not None and len(h):
                    slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    some = shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
                    h, at = h[some], at[some]
                ids.append(np.full(len(h), k))
                ats.append(at)
                hs.append(h.view(np.int64))
                held += len(h)
                if held > STEP_CHARS // 8 or k == len(batch) - 1:
                    rows = np.concatenate(ids)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(ats), pa.int32()), pa.array(np.concatenate(hs))], ["id", "at", "h"])
                    ids, ats, hs, held = [], [], [], 0
            if len(known) > 1_000_000:
                known.clear()

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, at int, h long")


def _filter(hashes: DataFrame) -> np.ndarray:
    """One bit for each value of the upper bits; what reaches the driver has at most 2^(FILTER_BITS - 6) rows."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    parts = hashes.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for word, bits in parts.toLocalIterator():
        out[word] = bits
    return out.view(np.uint8)


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_passages(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text_col: str = "text", item_col: str = "text", least: int = LEAST, n: int = N_WORDS) -> DataFrame:
    """text_id, item_id, start, item_start, length: each pair's longest common run of at least `least` words.

    Words are numbered from 0; of equally long runs the first in the text counts, then the first in the item. Ids must be
    unique and not null in `items`; rows of `texts` that repeat an id are one text, the greatest; null ids are left out.
    """
    if not 1 <= n <= least:
        raise ValueError("a run must hold at least one n-gram")
    docs = texts.where(F.col(text_id).isNotNull()).select(F.col(text_id).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    asked = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("i"), F.coalesce(F.col(item_col), F.lit("")).alias("t"))
    item_grams = _kept(grams(asked, "i", "t", n).withColumnRenamed("id", "i").withColumnRenamed("at", "q"), "item-grams")
    passed = grams(docs, "d", "t", n, _filter(item_grams)).withColumnRenamed("id", "d").withColumnRenamed("at", "p")
    hits = _kept(passed.join(item_grams.select("h").distinct(), "h", "left_semi"), "hits")
    counts = hits.groupBy("h").agg(F.count("*").alias("c"))
    ranked = item_grams.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # The rarest of the window that begins at each place: within one item, so rows follow an item's length.
    ahead = Window.partitionBy("i").orderBy("q").rowsBetween(0, least - n)
    rarest = ranked.select("i", F.min(F.struct("c", "q", "h")).over(ahead).alias("r"), F.count("*").over(ahead).alias("w"))
    anchors = rarest.where((F.col("w") == least - n + 1) & (F.col("r.c") > 0)).select("i", F.col("r.q").alias("q"), F.col("r.h").alias("h")).distinct()
    met = hits.join(anchors, "h").select("d", "i", (F.col("p") - F.col("q")).alias("shift")).distinct()
    # Of a text only the words along the diagonal are sent on to its item.
    cut = met.join(asked.select("i", F.size(words(F.col("t"))).alias("n")), "i").join(docs.groupBy("d").agg(F.max("t").alias("t")), "d")
    first = F.greatest(F.lit(0), F.col("shift"))
    part = F.slice(words(F.col("t")), first + 1, F.col("n") + F.col("shift") - first)
    pairs = cut.select("d", "i", first.alias("from"), (first - F.col("shift")).alias("item_from"), part.alias("a")).join(asked.select("i", words(F.col("t")).alias("b")), "i")
    same = F.zip_with("a", F.slice("b", F.col("item_from") + 1, F.greatest(F.size("a"), F.lit(0))), lambda x, y: x.eqNullSafe(y))
    # The longest stretch of equal words: (its length, where it ends), the first of equally long ones.
    begin = F.struct(F.lit(0).alias("now"), F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(0).alias("end"))

    def step(s: Column, equal: Column) -> Column:
        now, at = F.when(equal, s["now"] + 1).otherwise(0), s["at"] + 1
        better = now > s["best"]
        return F.struct(now.alias("now"), at.alias("at"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, at).otherwise(s["end"]).alias("end"))

    run = pairs.select("d", "i", "from", "item_from", F.aggregate(same, begin, step).alias("r")).where(F.col("r.best") >= least)
    begun = F.col("r.end") - F.col("r.best")
    best = F.max(F.struct(F.col("r.best").alias("length"), (-(F.col("from") + begun)).alias("start"), (-(F.col("item_from") + begun)).alias("item_start"))).alias("m")
    done = run.groupBy("d", "i").agg(best)
    return done.select(F.col("d").alias(text_id), F.col("i").alias(item_id), (-F.col("m.start")).cast("long").alias("start"), (-F.col("m.item_start")).cast("long").alias("item_start"), F.col("m.length").cast("long").alias("length"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_GRAM = " || ' ' || ".join(f"l[p + {k + 1}]" for k in range(N_WORDS))


@query(f"""with d as (select doc_id, {_WORDS} as l from documents), b as (select item_id, {_WORDS} as l from benchmark),
dg as (select doc_id, p, {_GRAM} as g from (select doc_id, l, unnest(range(len(l) - {N_WORDS - 1})) as p from d)),
bg as (select item_id, p as q, {_GRAM} as g from (select item_id, l, unnest(range(len(l) - {N_WORDS - 1})) as p from b)),
m as (select doc_id, item_id, p, q, p - row_number() over (partition by doc_id, item_id, p - q order by p) as island from dg join bg using (g)),
r as (select doc_id, item_id, min(p) as start, min(q) as item_start, count(*) + {N_WORDS - 1} as length from m group by doc_id, item_id, p - q, island having count(*) + {N_WORDS - 1} >= {LEAST})
select * from r qualify row_number() over (partition by doc_id, item_id order by length desc, start, item_start) = 1""")
def join_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark: where, and how long."""
    return shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
