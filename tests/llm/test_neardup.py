"""Near-duplicates by exact similarity, against all pairs."""

import random

import numpy as np

import corpus_pipeline
from millrace.llm import neardup, simhash

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    """(id, text) -> id: the smallest id reached through pairs with a Jaccard similarity of 0.8 of five-word runs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if group[k] == group[i]) for i in range(len(rows))}


def near_copies():
    """Texts of 30 to 400 words and copies with one to several words replaced, on both sides of 0.8; a chain too."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for n in (30, 60, 60, 120, 400):
        base = [word() for _ in range(n)]
        rows.append(" ".join(base))
        for changes in (1, 1, 2, 3, 5, 8, n // 40 + 1, n // 45 + 1):
            copy = list(base)
            for k in draw.sample(range(n), changes):
                copy[k] = word()
            rows.append(" ".join(copy).upper() if changes == 3 else " ".join(copy))
    chain = [word() for _ in range(100)]
    for k in range(0, 60, 3):
        rows.append(" ".join(chain[k:] + chain[:k] + [word()] * 2))
    return list(enumerate([*rows, None, "", " \n", "Four words are here", "four  words are here"]))


def test_groups_equal_all_pairs(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == want
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, SF).collect())
    assert kept == sorted(set(want.values()))
    assert len(kept) < simhash.representatives(df).count()
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_texts_that_meet_without_being_similar(spark, monkeypatch):
    """Variants of one text, most of them too different to be linked, share keys for several rounds of leads."""
    draw = random.Random(11)
    base = [f"word{k}" for k in range(120)]
    rows = []
    for n in range(70):
        copy = list(base)
        for k in draw.sample(range(120), 4):
            copy[k] = f"own{n}x{k}"
        rows.append((n, " ".join(copy)))
    rows += [(70 + n, text.replace("word0 ", "start ").replace("word119", "end")) for n, text in rows[::9]]
    want, rounds = brute_groups(rows), []
    told = neardup.similar
    monkeypatch.setattr(neardup, "similar", lambda *a: (rounds.append(a[0].count()), told(*a))[1])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    assert len(set(want.values())) > 30 and len(rounds) > 3


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_groups(sorted(map(tuple, docs.collect())))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == want


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        assert (neardup.keys_of(h[:80]) == neardup.keys_of(h[:80][::-1])).all()
        assert (neardup.keys_of(h[:81]) == neardup.keys_of(np.r_[h[9:81], h[81:]])).any()  # 72 of 90 in common


def test_boilerplate_is_not_checked_pair_by_pair(spark, monkeypatch):
    """Texts of which half is the same words share keys with each other; what is checked grows with them, not with their pairs."""
    told, checked = neardup.similar, []
    monkeypatch.setattr(neardup, "similar", lambda *a: (checked.append(a[0].count()), told(*a))[1])
    base, per_text = " ".join(f"word{k}" for k in range(150)), []
    for n in (200, 600):
        checked.clear()
        rows = [(k, f"{base} " + " ".join(f"own{k}x{j}" for j in range(100))) for k in range(n)] + [(n, f"{base} " + " ".join(f"own0x{j}" for j in range(99)))]
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {k: 0 if k == n else k for k in range(n + 1)}
        per_text.append(sum(checked) / n)
    assert per_text[1] < 2 * neardup.LEADS * neardup.BANDS and per_text[1] < 1.5 * per_text[0] + 1
