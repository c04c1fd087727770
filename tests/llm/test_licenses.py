"""op12: template markup against regular expressions and plain positions; the whole query against SQL in test_sql.py."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import licenses

MIT = dict(t for t in licenses.TEMPLATES if t[0] == "mit-text")["mit-text"]


def scan(text, templates=licenses.TEMPLATES):
    return licenses.Scanner(licenses.PHRASES, templates).scan(text)


def test_whole_license_text_with_its_regions():
    text = MIT
    for mark, word in (("<<var;name=copyright;words=0-30>>", "Copyright (c) 2020 Somebody"), ("<<var;name=holder;words=1-12>>", "AUTHORS OR COPYRIGHT HOLDERS")):
        text = text.replace(mark, word)
    text = re.sub("<<var;name=software;match=([^|]*)[^>]*>>", r"\1", text)
    full, bare = re.sub("<<.*?>>", "", text), re.sub("<<beginOptional>>.*?<<endOptional>>", "", text)
    for t in (full, bare, full.upper(), full.replace(" ", "\n * ")):
        assert "mit-text" in {label for _, _, label in scan(f"some code {t} more")[2]}
    for changed in (full.replace("free of charge", "for a fee"), full.replace("fitness", "health").replace("FITNESS", "HEALTH"), full.replace("AUTHORS OR COPYRIGHT HOLDERS", "a " * 13), full[: len(full) // 2]):
        assert "mit-text" not in {label for _, _, label in scan(changed)[2]}


def test_places_overlap_and_are_counted():
    n, base, spans = scan("CC-BY cc by; CC BY NC 4.0 (the MIT\nlicense) mit license mit")
    assert n == 15 and base == [(0, 2, "cc-by"), (2, 2, "cc-by"), (4, 2, "cc-by"), (10, 2, "mit"), (12, 2, "mit")]
    assert spans == [(4, 5, "cc-by-nc-4.0")]
    assert scan("ccby ccé by mit licenses") == (5, [], [])


MARKED = [
    "a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> a<<endOptional>> b <<var;words=0-2>> c",
    "<<var;match=a b|b>> <<var;words=1-2>> a <<beginOptional>>b<<endOptional>>",
    "a <<var;match=a|a b|c d>> a",
    "<<beginOptional>>d<<endOptional>> b a <<var;words=2-3>> <<beginOptional>>a b<<endOptional>> d <<var;words=0-9>>",
]


@given(st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=500, deadline=None)
def test_automata_equal_regular_expressions(words):
    line = " " + "".join(w + " " for w in words)
    for k, marked in enumerate(MARKED):
        found = licenses.Scanner({}, [(str(k), marked)]).scan(" ".join(words))[2]
        assert bool(found) == bool(re.search(licenses.regex(marked), line))
        for start, length, _ in found:  # what is accepted is accepted by itself
            assert re.fullmatch(licenses.regex(marked), " " + "".join(w + " " for w in words[start : start + length]))


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a <<endOptional>>", "a <<var;name=x>> b", "<<var;words=1-2>> a", "<<any>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_markup_is_refused(bad):
    with pytest.raises(ValueError):
        licenses.Scanner({}, [("x", bad)])


def test_odd_rows(spark):
    long = "word " * 50_000 + "Released under the MIT License " + "word " * 50_000
    texts = [None, "", " .. ", "MIT License", "Apache License Apache License, Version 2.0", long, "\u0000mit license😀"]
    rows = [(k if k else None, t, "x", 1, 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, spans string, base int, n int")
    got = [(r["doc_id"], r["n_words"], len(r["base"]), [s["label"] for s in r["spans"]], r["score"]) for r in licenses.scan(df, ["doc_id", "spans"]).withColumn("score", licenses.certainty()).collect()]
    want = [(None, 0, 0, [], 0.0), (1, 0, 0, [], 0.0), (2, 0, 0, [], 0.0), (3, 2, 1, [], 0.5), (4, 7, 2, ["apache-2.0"], 0.9375), (5, 100_005, 1, ["mit-notice"], 0.875), (6, 2, 0, [], 0.0), (3, 2, 1, [], 0.5)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0
