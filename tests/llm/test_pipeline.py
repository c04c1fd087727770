"""The pipeline's stages against plain Python, on documents with planted near copies, short ones too."""

import random

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from millrace.llm import langid, linededup, quality, queries
from millrace.llm.common import written

from .test_neardup import brute_groups
from .test_operators import _brute_lines

SF = "/root/testdata/sf0.001"


def planted(spark):
    """The documents and 8 texts of 50 and 90 words in the words of long documents, each with a copy that differs in the middle (similarity 0.8 and 0.89)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, draw = docs.collect(), random.Random(5)
    long = [r for r in rows if r["lang"] == "en" and len(r["text"].split()) > 300][:8]
    for k, r in enumerate(long):
        words = r["text"].split()
        draw.shuffle(words)
        words = words[: 50 if k % 2 else 90]
        for n in (0, 1):
            text = " ".join([*words[: len(words) // 2], "changed" if n else "middle", *words[len(words) // 2 + 1 :]])
            rows.append((100_000 + 2 * k + n, text, "en", r["source"], len(text)))
    return spark.createDataFrame(rows, docs.schema)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def accepted(row, rows, table, cache={}):  # noqa: B006
    """The language stage's decision: text and host (`source`), as langid's docstring has it."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    smooth = lambda c, q: (c + langid.STRENGTH * q) / (c.sum() + langid.STRENGTH)
    if not cache:
        for r in rows:
            nats = langid.nats_of(table, langid.trigrams(r["text"]))
            cache[r["doc_id"]] = nats
            cache[("host", r["source"])] = cache.get(("host", r["source"]), 0) + soft(nats)
        cache["every"] = sum(soft(cache[r["doc_id"]]) for r in rows)
    own = soft(cache[row["doc_id"]])  # its own text is no part of the counts that serve it
    others = cache["every"] - own
    top = (others + 1) / (others.sum() + len(others))
    p = soft(cache[row["doc_id"]] + np.log(smooth(cache[("host", row["source"])] - own, top)))
    return p.max() >= langid.LEAST_POSTERIOR and langid.letter_share(row["text"]) >= langid.LEAST_LETTERS


def test_stages_equal_plain_python(spark):
    now = written(planted(spark), "planted")
    before, model = texts(now), queries.fit_quality(now, SF)
    now = written(corpus_pipeline.quality_stage(spark, now, SF), "quality")
    measure = quality.Measure(model.good, model.bad)
    assert texts(now) == {i: t for i, t in before.items() if quality.scores(model, np.array([measure(t)]))[0] >= 0.3}

    before, rows = texts(now), now.collect()
    table = langid.table_of(langid.fit_trigrams(now.where(~queries.held_out()), queries.LANGUAGES))
    now = written(corpus_pipeline.language_stage(spark, now, SF), "language")
    assert texts(now) == {r["doc_id"]: r["text"] for r in rows if accepted(r, rows, table)} and len(texts(now)) > 0.9 * len(before)

    before = texts(now)
    now = written(corpus_pipeline.line_stage(spark, now, SF), "line")
    lines = _brute_lines(sorted(before.items()), linededup.MIN_WORDS)
    assert texts(now) == {i: t for i, t in lines.items() if t == before[i] or t.strip(" ")}

    before = texts(now)
    now = written(corpus_pipeline.near_stage(spark, now, SF), "near")
    groups = brute_groups(sorted(before.items()))
    assert texts(now) == {i: t for i, t in before.items() if groups[i] == i}
    assert sum(i >= 100_000 and groups[i] != i for i in before) >= 3  # near copies that the line stage leaves

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in sorted(corpus_pipeline.packing_stage(spark, now, SF).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = [*got.get(r["doc_id"], []), *r["ids"]]
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(now).items()}
