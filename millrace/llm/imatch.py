"""I-Match document fingerprints, in DataFrame operations alone.

Terms are the lower-cased words of a text, as XXH64. Their document frequency is counted over all documents, exactly. The
lexicon is the band of inverse document frequencies between `low` and `high` shares of all documents: at most the mean
number of distinct terms of a text divided by `low` terms, whatever the vocabulary, as each is in `low` of the texts. It is
counted before it is used: up to `INLINE_TERMS` terms become a hash table, one array that a scalar subquery puts into the
plan; a larger one stays a table, which each text's terms are joined with.

A text's fingerprint keeps its terms inside the lexicon, sorts the distinct ones, and hashes 96 randomised subsets of the
lexicon: 32 that hold a term each with chance 1/32, 32 with 1/128 and 32 with 1/512, so that short and long texts alike have
subsets with few terms, which small edits leave as they are. A text without terms in the band (short ones) uses all of its
terms. Two fingerprints are as alike as the share of subsets, among those that either has terms in, that agree.

Nulls and edges: a null text counts as empty; a text without any word has the fingerprint of no terms, which is alike
(1.0) only to another of the kind; equal texts have equal fingerprints; repeated rows give equal rows; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The band of document shares that a lexicon term lies in.
LOW, HIGH = 0.0002, 0.05
#: Lexicons of up to this many terms go into the plan (2 to 4 slots of 8 bytes a term), larger ones are joined.
INLINE_TERMS = 250_000
#: Subsets of each kind, and how many slots a term of that kind is dealt to (the first PARTS slots are subsets).
PARTS = 32
SLOTS = (32, 128, 512)


def words_of(text: Column) -> Column:
    """XXH64 of each lower-cased word, repeats included."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term long, df long) over all rows."""
    return df.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class Lexicon:
    terms: DataFrame  # term long
    bits: int  # the hash table has 2^bits slots
    slots: DataFrame | None  # the hash table, one array (0: no term), or None where the terms are too many


def lexicon(df: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, inline_terms: int = INLINE_TERMS) -> Lexicon:
    """The terms whose share of all documents lies in the band."""
    n = df.count()
    band = document_frequencies(df, text_col).where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n)))
    terms = written(band.select("term"), "lexicon")
    if terms.count() > inline_terms:
        return Lexicon(terms, 0, None)
    table = hash_table([r["term"] for r in terms.collect()])
    return Lexicon(terms, len(table).bit_length() - 1, written(df.sparkSession.createDataFrame([(table,)], "slots array<long>"), "slots"))


def hash_table(terms: list[int]) -> list[int]:
    """Each term stands in the slot of its low bits or in that of its high bits; the size is a power of two."""
    bits = max(4, (2 * len(terms)).bit_length())
    while True:
        mask, table = (1 << bits) - 1, [0] * (1 << bits)
        for term in terms:
            at = term & mask
            for _ in range(500):  # whoever stands there moves to its other slot
                term, table[at] = table[at], term
                if not term:
                    break
                low, high = term & mask, (term % (1 << 64)) >> (64 - bits)
                at = high if at == low else low
            if term:
                break
        else:
            return table
        bits += 1


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_terms(text: Column) -> Column:
    return F.sort_array(F.array_distinct(words_of(text)))


def in_band(terms: Column, table: Column, bits: int) -> Column:
    """Those of `terms` that stand in the hash table; all of them if none does."""

    def inside(h: Column) -> Column:
        low = F.get(table, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
        return (low == h) | (F.get(table, F.shiftrightunsigned(h, 64 - bits).cast("int")) == h)

    return _let(F.filter(terms, inside), lambda band: F.when(F.size(band) > 0, band).otherwise(terms))


def with_terms(df: DataFrame, lex: Lexicon, text_col: str, name: str) -> DataFrame:
    """`df` and, as `name`, each text's distinct terms inside the lexicon, sorted; all of its terms if none is."""
    if lex.slots is not None:
        # Spark takes no subquery where it reads a lambda, so the table is a column first; the projections are then merged.
        made = _let(F.col("__table"), lambda table: _let(sorted_terms(F.col(text_col)), lambda t: in_band(t, table, lex.bits)))
        return df.withColumn("__table", lex.slots.scalar()).withColumn(name, made).drop("__table")
    rows = df.withColumn("__text", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    each = rows.select("__text", F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("term")).join(lex.terms, "term")
    band = each.groupBy("__text").agg(F.sort_array(F.collect_set("term")).alias("__band"))
    return rows.join(band, "__text", "left").withColumn(name, F.coalesce("__band", sorted_terms(F.col(text_col)))).drop("__text", "__band")


def subset_hashes(terms: Column) -> Column:
    """array<int>: for each subset the hash of its terms in order, 0 for a subset without terms.

    A term's slot is read from 5, 7 or 9 of its bits. Turned so that these are its uppermost, sorting brings the terms of a
    subset together (slots whose uppermost bit is set first, as longs are signed); marks between them tell where each ends.
    """

    def one_kind(t: Column, shift: int, width: int) -> Column:
        turn = lambda h: F.shiftleft(h, 64 - shift - width).bitwiseOR(F.shiftrightunsigned(h, shift + width))
        marks = [j << (64 - width) for j in range(PARTS + 1)]
        signed = [m - (1 << 64) if m >> 63 else m for m in marks if m < 1 << 64]
        if width > 5:  # slots from PARTS on are no subsets
            t = F.filter(t, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1)) < PARTS)
        ends = F.sort_array(F.array(*map(F.lit, signed)))
        laid = F.sort_array(F.concat(F.transform(t, turn), ends))

        def pieces(all_: Column) -> Column:
            last = F.size(all_) + 1
            where = F.concat(F.transform(ends, lambda m: F.array_position(all_, m).cast("int")), F.array(last))
            return _let(where, lambda at: F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda j: run(all_, F.element_at(at, j) + 1, F.element_at(at, j + 1) - F.element_at(at, j) - 1)))

        def run(all_: Column, begin: Column, n: Column) -> Column:
            return F.when(n > 0, (F.shiftrightunsigned(F.xxhash64(F.slice(all_, begin, n)), 33) + 1).cast("int")).otherwise(F.lit(0))

        return _let(laid, pieces)

    kinds, shift = [], 24
    for width in (slots.bit_length() - 1 for slots in SLOTS):
        kinds.append((shift, width))
        shift += width
    return _let(terms, lambda t: F.concat(*(one_kind(t, *k) for k in kinds)))


def as_text(hashes: Column) -> Column:
    """The fingerprint as a string: 8 hex digits a subset."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets that agree among those that a or b has terms in; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)))

    def share(v: Column) -> Column:
        used = F.size(F.filter(v, lambda x: x > 0))
        return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.filter(v, lambda x: x == 2)) / used)

    return _let(pairs, share)


def fingerprints(df: DataFrame, lex: Lexicon, text_col: str, name: str) -> DataFrame:
    """`df` and, as `name`, the hashes of each text's subsets."""
    return with_terms(df, lex, text_col, "__terms").withColumn(name, subset_hashes(F.col("__terms"))).drop("__terms")


def with_next(chain: DataFrame) -> DataFrame:
    """`chain` (key long, no repeats; text; fp) and `next_text`, `fp_next` of the next lower key; the lowest has the highest's.

    Keys are cut into ranges at quantiles, several for each shuffle partition, and each range is one window. The highest
    key of a range goes to the range above it too, where it stands below the others.
    """
    ranges = 8 * int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = chain.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    # The highest key of each range that has any: one row a range.
    tops = sorted(r["top"] for r in chain.select("key", _below(sorted(set(cuts)), F.col("key")).alias("part")).groupBy("part").agg(F.max("key").alias("top")).collect())
    part = _below(tops, F.col("key"))
    guest = F.when(F.get(_longs(tops), part) == F.col("key"), F.pmod(part + 1, F.lit(max(1, len(tops)))))
    both = F.when(guest.isNull(), F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(guest.alias("part"), F.lit(True).alias("guest"))))
    dealt = chain.withColumn("__in", F.explode(both)).select("*", "__in.part", "__in.guest").drop("__in")
    order = Window.partitionBy("part").orderBy(F.desc("guest"), "key")
    seen = dealt.withColumn("__below", F.lag(F.struct("text", "fp")).over(order)).where(~F.col("guest"))
    return seen.select(*chain.columns, F.col("__below.text").alias("next_text"), F.col("__below.fp").alias("fp_next"))


def _longs(values) -> Column:
    """An array; Spark folds the parsing into a literal when it optimises the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _below(values: list[int], key: Column) -> Column:
    """How many of the sorted `values` are below `key`, by bisection."""
    ends = _longs(values)

    def further(step: int):
        return lambda at: F.when(F.get(ends, at + (step - 1)) < key, at + step).otherwise(at)

    out = F.lit(0)
    for bit in reversed(range(len(values).bit_length())):
        out = _let(out, further(1 << bit))
    return out


def edited_and_next(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, and both likenesses.

    The edited text has the last floor(n / 2) code points replaced by the first as many of the next document, in
    descending id (after the last: the first). Rows that share an id follow each other as one document: the next is
    then the smallest text of the next id. A null id counts as the smallest.

    Every text is fingerprinted once and shuffled once, and its edited text is fingerprinted where it is made. Only where
    ids repeat, the smallest text of each id (combined before it is shuffled) makes the chain, which the rows are joined with.
    """
    none = F.lit(-(1 << 63))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), none).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = fingerprints(docs, lex, "text", "fp")
    if docs.groupBy("key").count().where("count > 1").isEmpty():
        rows = with_next(marked)
    else:
        chain = with_next(fingerprints(docs.groupBy("key").agg(F.min("text").alias("text")), lex, "text", "fp"))
        rows = marked.join(written(chain.select("key", "next_text", "fp_next"), "chain"), "key")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = fingerprints(rows.select("key", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "fp_next"), lex, "edited", "fp_edited")
    made = made.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct("fp", "fp_next", "fp_edited"))).alias("r"))
    return made.select(
        F.when(F.col("key") != none, F.col("key")).cast(df.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256",
        as_text(F.col("r.fp")).alias("fingerprint"), as_text(F.col("r.fp_edited")).alias("edited_fingerprint"), likeness(F.col("r.fp"), F.col("r.fp_edited")).alias("near_edited"), likeness(F.col("r.fp"), F.col("r.fp_next")).alias("near_next"),
    )
