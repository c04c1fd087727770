"""op3 and op6 on long runs of white space: the libraries' ids, in near-linear time, and without harm to other rows."""

import time

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing, pieces, queries

MODEL = pieces.load_model(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TOKENIZER = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = packing.encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)

gaps = st.lists(st.sampled_from([" ", "  ", " " * 7, " " * 15, " " * 16, " " * 17, " " * 33, "the", "a", "t", "s", "\n", "é", "==", "日本", "▁", "\n    return x", "<|endoftext|>", "　" * 9, "\n\n\n\t\t \n", "1", "."]), max_size=14).map("".join)


def piece_ids(text):
    MODEL.cache.clear()
    return [int(i) for w in pieces.encode_texts(MODEL, [text])[0] for i in w.split(" ")]


@given(gaps)
@settings(max_examples=400, deadline=None)
def test_piece_ids_of_runs_of_spaces(text):
    usual = pieces.LONG_WORD
    for bound in (1, usual):
        pieces.LONG_WORD = bound
        try:
            assert piece_ids(text) == LIBRARY.encode(text)
        finally:
            pieces.LONG_WORD = usual


@given(gaps)
@settings(max_examples=400, deadline=None)
def test_byte_ids_of_runs_of_spaces(text):
    usual = packing.LONG_SPACE
    for bound in (3, usual):
        packing.LONG_SPACE = bound
        try:
            assert ENCODE(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
        finally:
            packing.LONG_SPACE = usual


@pytest.mark.parametrize("text", [" " * 1_000_000, "x = 1\n" + " " * 200_000 + "y", ("\n" + " " * 40 + "return x") * 3000, "a " * 100_000], ids=["spaces", "tail", "code", "words"])
def test_piece_ids_in_near_linear_time(text):
    began = time.time()
    ids = piece_ids(text)
    assert time.time() - began < 8 and ids == LIBRARY.encode(text)


LONG = ["word" + " " * 2_000_000 + "word", "\n" * 2_000_000, "a" + " \n\t" * 700_000 + "b", "a" + " \n" * 600_000 + "<|endoftext|>" + " " * 5000, " " * 4096 + "b" + " " * 4095 + "c"]


def test_packing_of_long_white_space(spark):
    texts = ["first", *LONG, None, "", "last one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.tokenizer_pattern(), with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]] += r["ids"]
    for k, text in enumerate(texts):
        assert got[k] == [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
