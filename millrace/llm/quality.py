"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is compressed in blocks of `BLOCK`
bytes (whole, block by block, so that a long text can't replace the dictionary by itself) with either; the normalised
difference of the sizes, (good - bad) / (good + bad), says which kind it is closer to. A logistic curve, fitted on other
labelled texts, turns it into a calibrated probability that the label is 1; the curve also sees how far the text
compresses at all and how long it is, as the difference means little for short or endlessly repeating texts.

Fitting uses a bounded sample of rows: of each label the `sample` documents with the smallest hash of their id for the
dictionaries, of those with at most `LONGEST` characters, and as many others of any length for the curve; of these only the
figures reach the driver. All are taken whole, and everything else runs on all rows. A dictionary is trained on the sampled texts
of its label; where the trainer has too little to choose from (it refuses few texts, or texts all alike), nothing is chosen:
the dictionary is all distinct sampled texts of the label, whole. The curve takes up what sizes that leaves different.

Nulls and edges: a null text counts as empty; an empty text has difference 0 and gets the curve's value there; labels
that are null are left out, and of a document labelled twice the mean counts; without both labels among the training
rows there is nothing to learn and every score is the smoothed share of label 1; repeated rows give equal rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts, written

#: Documents a label for each of dictionary and curve, and the most characters of one for the dictionary.
SAMPLE, LONGEST = 1500, 10_000
DICTIONARY, BLOCK, LEVEL = 65_536, 256, 6


@dataclass(frozen=True)
class Model:
    good: bytes  # dictionaries; empty where there was nothing to learn
    bad: bytes
    weights: tuple[float, ...]
    share: float  # of label 1 among the training labels


class Measure:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.by)
        return len(data), good, bad


def figures(sizes: np.ndarray) -> np.ndarray:
    """The curve's inputs from (bytes, good, bad) rows; the first is the normalised difference."""
    n, good, bad = sizes.T.astype(np.float64)
    some = n > 0
    difference = np.where(some, (good - bad) / np.maximum(good + bad, 1), 0.0)
    ratio = np.where(some, np.log(np.maximum(np.minimum(good, bad), 1) / np.maximum(n, 1)), -0.7)
    length = np.log1p(n) - 7
    sure = difference * np.minimum(1.0, n / 300)
    return np.stack([10 * difference, 10 * sure, ratio, ratio**2, length, np.ones(len(n))], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scores(model: Model, sizes: np.ndarray) -> np.ndarray:
    if not model.weights:
        return np.full(len(sizes), model.share)
    return 1 / (1 + np.exp(-np.clip(figures(sizes) @ np.array(model.weights), -30, 30)))


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; of samples that the trainer can't choose from all that differ, whole.

    Raw content must have some bytes, so it begins with spaces.
    """
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" " * 16 + b"".join(dict.fromkeys(samples))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows that `train` (a condition on the id) admits; all, if it is not given."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (train if train is not None else F.lit(True)))
    known = known.groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
    sizes = docs.select(id_col, F.coalesce(F.length(text_col), F.lit(0)).alias("__n")).join(known, id_col)
    known = sizes.groupBy(id_col, "__y").agg((F.max("__n") <= LONGEST).alias("__short"))
    known = written(known.withColumn("__h", F.xxhash64(F.col(id_col), F.lit(11))), "labels")
    totals = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if len(totals) < 2:
        return Model(b"", b"", (), share)
    picked = []
    for y in (0, 1):
        n = min(sample, (totals[y] + 1) // 2)
        rows = known.where(F.col("__y") == y).orderBy("__h", id_col).limit(2 * n).select(id_col, "__short").collect()
        # Short enough ones take turns; those that are too long for a dictionary go to the curve.
        turn = 0
        for r in rows:
            turn += r["__short"]
            picked.append((r[0], y, "dictionary" if r["__short"] and turn % 2 else "curve"))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked, docs.select(id_col, F.lit(0).alias("__y"), F.lit("").alias("__use")).schema)
    texts = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(chosen), id_col)
    whole = texts.where("__use = 'dictionary'").select(id_col, "__y", F.col("__text").alias("t"))
    by: dict[int, list] = {0: [], 1: []}
    for r in whole.collect():
        by[r["__y"]].append((r[0], r["t"].encode()))
    good, bad = (dictionary([t for _, t in sorted(by[y]) if t]) for y in (1, 0))
    measured = measure(texts.where("__use = 'curve'"), [id_col, "__y"], "__text", good, bad)
    rows = sorted((r[id_col], r["__y"], r["n_bytes"], r["good"], r["bad"]) for r in measured.collect())
    if not {r[1] for r in rows} == {0, 1}:
        return Model(good, bad, (), share)
    y = np.array([r[1] for r in rows], np.float64)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(good, bad, tuple(fit_curve(figures(np.array([r[2:] for r in rows])), y, weight).tolist()), share)


def measure(df: DataFrame, kept: list[str], text_col: str, good: bytes, bad: bytes) -> DataFrame:
    """`kept` columns and the sizes n_bytes, good, bad."""
    shared = df.sparkSession.sparkContext.broadcast((good, bad))

    def rows(texts: list[str | None]) -> dict:
        sized = np.array(list(map(Measure(*shared.value), texts)), np.int64).reshape(-1, 3)
        return dict(zip(("n_bytes", "good", "bad"), sized.T, strict=True))

    return over_texts(df, kept, text_col, "n_bytes long, good long, bad long", rows)


def score(df: DataFrame, model: Model, kept: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`kept` columns, score (0 to 1, higher: label 1 is likelier), predicted (1 from `threshold` on), difference."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(texts: list[str | None]) -> dict:
        m = shared.value
        if m.weights:
            sizes = np.array(list(map(_measure(m), texts)), np.int64).reshape(-1, 3)
        else:
            sizes = np.zeros((len(texts), 3), np.int64)
        s = scores(m, sizes)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32), "difference": figures(sizes)[:, 0] / 10}

    return over_texts(df, kept, text_col, "score double, predicted int, difference double", rows)


_MEASURES: dict = {}


def _measure(m: Model) -> Measure:
    key = hash((m.good, m.bad))
    if key not in _MEASURES:
        _MEASURES.clear()
        _MEASURES[key] = Measure(m.good, m.bad)
    return _MEASURES[key]
