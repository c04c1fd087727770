"""Language identification by Bayesian evidence fusion.

Evidence of one row: its text (a naive Bayes likelihood over character trigrams, tempered, since neighbouring
trigrams are not independent), the language its markup declares, its address's suffix, and its host. Declarations and
suffixes are likelihoods of one symbol each, learnt by counting them against the texts' languages and smoothed. The
host's prior is smoothed hierarchically: all documents, then the suffix, then the host, each level a Dirichlet prior
with `strength` pseudo-documents for the one below; all counts are sums of text posteriors by grouped aggregation over
all documents, so a host of any size is summed on the map side. A row's own text is taken out of the counts that serve it
(leave one out), so that it is evidence once.

The language that a row is labelled with, where it is, serves to fit the trigram model only and is no evidence. Every text
is cut into trigrams once: what it says is written before it is summed for the priors and joined with them.

The trigram model is fitted on a sample of about `sample` distinct texts a language (those with small hashes), which are
cut into trigrams whole and summed on the executors; only the model's table (2^16 rows a language) reaches the driver.

The priors go to the rows by a broadcast only where they have at most `broadcast_hosts` rows, else by a shuffled join.

Nulls and edges: a null or empty text has no text evidence, its other evidence decides; null declarations, suffixes and
hosts are evidence of nothing (host and suffix then share one group); ties go to the language first in order; repeated
rows are counted and returned each; an empty table gives an empty result. Of the kept columns those with a name of the
result's own (`RESULT`) are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts, written

TABLE = 1 << 16
SAMPLE = 2000
#: A trigram's weight in the posterior, and the most nats that text alone may contribute.
TEMPER, MOST_NATS = 0.1, 40.0
STRENGTH = 20.0
BROADCAST_HOSTS = 100_000
#: Below this posterior, or with a share of letters below this one, no language is claimed.
LEAST_POSTERIOR, LEAST_LETTERS = 0.6, 0.2


RESULT = ("language", "probability", "accepted", "text_language")


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points, anything but a letter as a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    # Letters: ASCII a-z and everything from U+00AA up that is no common punctuation or space.
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xAA) & ~((c >= 0x2000) & (c <= 0x2BFF)) & (c != 0xD7) & (c != 0xF7) & (c != 0xAB) & (c != 0xBB) & (c < 0xFE00))
    return np.where(letter, c, 32)


def trigrams(text: str | None) -> np.ndarray:
    """Folded hashes of the text's trigrams, repeats included; all that stands between two words is one border."""
    return _hashes(_letters(f" {text or ''} "))


def _hashes(c: np.ndarray) -> np.ndarray:
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep].astype(np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def _share(c: np.ndarray, text: str) -> float:
    """Letters among the characters that are not spaces."""
    ink = sum(map(len, text.split()))
    return min(1.0, float((c != 32).sum()) / ink) if ink else 0.0


def letter_share(text: str | None) -> float:
    return _share(_letters(text or ""), text or "")


def nats_of(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Tempered log likelihoods by language, the best 0; `table` has a row for each folded hash."""
    s = table[grams].sum(axis=0, dtype=np.float64) * TEMPER if len(grams) else np.zeros(table.shape[1])
    return np.maximum(s - s.max(), -MOST_NATS)


def fit_trigrams(df: DataFrame, languages: list[str], label_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities, languages x TABLE, from about `sample` distinct labelled texts a language."""
    h = F.xxhash64(text_col, F.lit(7))
    # Hashes are even over their range, so a share of it is a sample; nothing is sorted.
    known = df.where(F.col(label_col).isin(languages) & F.col(text_col).isNotNull()).groupBy(label_col).agg(F.approx_count_distinct(h))
    most = {r[0]: (1 << 63) - 1 if r[1] <= sample else -(1 << 63) + (1 << 64) * sample // r[1] for r in known.collect()}
    # Copies of one text have one hash: a copied text counts once.
    texts = df.where(F.col(text_col).isNotNull())
    cond = F.lit(False)
    for lang, bound in most.items():
        cond = cond | ((F.col(label_col) == lang) & (h <= bound))
    texts = texts.where(cond).select(label_col, text_col).distinct()
    names = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        import pandas as pd

        sums = np.zeros((len(names), TABLE), np.int64)
        for pdf in batches:
            for lang, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                sums[names[lang]] += np.bincount(trigrams(text), minlength=TABLE)
        lang, gram = np.nonzero(sums)
        yield pd.DataFrame({"k": lang * TABLE + gram, "n": sums[lang, gram]})

    counts = np.zeros(len(names) * TABLE)
    for r in texts.mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"]] = r["n"]
    counts = counts.reshape(len(names), TABLE) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def table_of(model: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((model - model.mean(axis=0)).T.astype(np.float32))


def with_text_evidence(df: DataFrame, kept: list[str], model: np.ndarray, text_col: str = "text") -> DataFrame:
    """`kept` columns, `__nats` array<double> and `__letters` double."""
    shared = df.sparkSession.sparkContext.broadcast(table_of(model))

    def rows(texts: list[str | None]) -> dict:
        table = shared.value
        nats, letters = [], []
        for t in texts:
            c = _letters(f" {t or ''} ")
            nats.append(nats_of(table, _hashes(c)))
            letters.append(_share(c, t or ""))
        return {"__nats": nats, "__letters": letters}

    return over_texts(df, kept, text_col, "__nats array<double>, __letters double", rows)


def posterior(logs: Column) -> Column:
    """exp and normalise."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(langs: int) -> list[Column]:
    return [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(langs)]


def identify(df: DataFrame, kept: list[str], languages: list[str], text_col: str = "text", label_col: str = "lang", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, model: np.ndarray | None = None, strength: float = STRENGTH, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """`kept` columns, language, probability, accepted, and the text's best language alone.

    `label_col` names the column that the trigram model is fitted on, where `model` is not given.
    """
    languages = sorted(languages)
    kept = [c for c in kept if c not in RESULT]
    n = len(languages)
    if model is None:
        model = fit_trigrams(df, languages, label_col, text_col)
    nothing = F.lit(None).cast("string")
    text = text_col if text_col in kept else "__text"
    given = df.select(*kept, *[F.col(text_col).alias(text)] * (text not in kept), F.coalesce(declared if declared is not None else nothing, F.lit("")).alias("__declared"), F.coalesce(suffix if suffix is not None else nothing, F.lit("")).alias("__suffix"), F.coalesce(host if host is not None else nothing, F.lit("")).alias("__host"))
    evidence = written(with_text_evidence(given, [*kept, "__declared", "__suffix", "__host"], model, text), "evidence")
    # One pass of grouped sums; all levels of the hierarchy come from it.
    p = evidence.select("__declared", "__suffix", "__host", posterior(F.col("__nats")).alias("p"))
    base = written(p.groupBy("__declared", "__suffix", "__host").agg(*_sums(n)), "hosts")
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    total = base.agg(*add).first()
    arr = F.array(*(F.col(f"s{i}") for i in range(n)))
    by_suffix = base.groupBy("__suffix").agg(*add).select("__suffix", arr.alias("__of_suffix"))
    hosts = base.groupBy("__suffix", "__host").agg(*add).select("__suffix", "__host", arr.alias("__of_host")).join(by_suffix, "__suffix")
    decl = base.groupBy("__declared").agg(*add).select("__declared", arr.alias("__of_declared"))
    hosts, decl = written(hosts, "priors"), written(decl, "declared")
    host_side = F.broadcast(hosts) if hosts.count() <= broadcast_hosts else hosts
    decl_side = F.broadcast(decl) if decl.count() <= broadcast_hosts else decl
    joined = evidence.join(host_side, ["__suffix", "__host"]).join(decl_side, "__declared")

    def others(counts: Column) -> Column:
        """Without the row's own text; never below 0 by rounding."""
        return F.zip_with(counts, "__own", lambda c, p: F.greatest(c - p, F.lit(0.0)))

    def smoothed(counts: Column, above: str) -> Column:
        """Of the others' counts, with `strength` pseudo-documents as the level above has them."""
        left = others(counts)
        mass = F.aggregate(left, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(left, above, lambda c, q: (c + strength * q) / (mass + strength))

    # Each level is a column of its own, so that it is computed once.
    every = F.array(*(F.lit(float(total[i] or 0.0)) for i in range(n)))
    levels = joined.withColumn("__own", posterior(F.col("__nats"))).withColumn("__all", others(every))
    levels = levels.withColumn("__top", F.transform("__all", lambda c: (c + 1.0) / (F.aggregate("__all", F.lit(0.0), lambda a, b: a + b) + n)))
    levels = levels.withColumn("__by_suffix", F.when(F.col("__suffix") == "", F.col("__top")).otherwise(smoothed(F.col("__of_suffix"), "__top")))
    levels = levels.withColumn("__prior", F.when(F.col("__host") == "", F.col("__by_suffix")).otherwise(smoothed(F.col("__of_host"), "__by_suffix")))
    # log P(symbol | language), up to what is equal for all languages: how much a symbol raises a language.
    raised = F.zip_with(smoothed(F.col("__of_declared"), "__top"), "__top", lambda a, b: F.log(a / b))
    levels = levels.withColumn("__declared_nats", F.when(F.col("__declared") == "", F.array(*[F.lit(0.0)] * n)).otherwise(raised))
    logs = F.zip_with(F.zip_with(F.col("__nats"), F.col("__declared_nats"), lambda a, b: a + b), F.transform("__prior", lambda q: F.log(q)), lambda a, b: a + b)
    done = levels.withColumn("__logs", logs).withColumn("__post", posterior(F.col("__logs")))
    best = F.array_max("__post")
    names = F.array(*map(F.lit, languages))
    pick = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    accepted = (best >= LEAST_POSTERIOR) & (F.col("__letters") >= LEAST_LETTERS)
    return done.select(*kept, pick(F.col("__post")).alias("language"), best.alias("probability"), accepted.alias("accepted"), pick(F.col("__nats")).alias("text_language"))
