"""Pure parts of the operators against brute force and against the libraries they must equal."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import ann, chat, common, langid, linededup, packing, pieces, quality, simhash, urlfilter

MODEL = pieces.load_model(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TOKENIZER = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE = packing.encoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)

texts = st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=80) | st.text(alphabet=list("aābcehilnorst -=0\n ▁é日😀\t<|im_start|>end."), max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_pieces_equal_the_library(text):
    words = pieces.encode_texts(MODEL, [text])[0]
    ids = list(map(int, " ".join([*words, str(MODEL.end_id)]).split(" ")))
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert pieces.decode_ids(MODEL, ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "   a", "x" * 5000, "ab" * 700, "=" * 333, "\x00 a", "</s><s><unk><0x0A>"])
def test_pieces_edges(text):
    words = pieces.encode_texts(MODEL, [text, None])
    ids = list(map(int, " ".join([*words[0], "2"]).split(" ")))
    assert ids == LIBRARY.encode(text, add_eos=True) and words[1] == []
    assert pieces.decode_ids(MODEL, ids) == LIBRARY.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_packer_takes_the_least_sum_of_squares(sizes):
    packer, fills = packing.Packer(64), {}
    for n in sizes:
        counts = np.bincount([f for f in fills.values() if f < 64], minlength=65)

        def cost(level, n=n, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + n < 64:
                c[level + n] += 1
            return int((c**2).sum())

        best = min(cost(h) for h in {0, *(f for f in fills.values() if f + n <= 64)})
        window, offset = packer.put(n)
        assert offset == fills.get(window, 0) and offset + n <= 64 and cost(offset) == best
        fills[window] = offset + n
    assert packer.left_open() == {w: f for w, f in fills.items() if f < 64}


def test_refill_fills_gaps_then_powers_of_two():
    loose = [("a", 0, 20, 100, 0, 0, None, np.arange(20)), ("b", 7, 31, 68, 1, 0, None, np.arange(31))]
    rows = packing.refill(loose, [(3, 34), (2, 60)], 5, 64)
    by = {}
    for key, start, n, _, window, offset, _, ids in rows:
        assert offset == {3: 34, 2: 60}.get(window, 0) + sum(by.setdefault(window, [])) and len(ids) == n
        by[window].append(n)
    assert {w: sum(v) for w, v in by.items()} == {3: 30, 2: 4, 5: 16, 6: 1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.sampled_from([0, 0.005, 0.1]))
def test_closing_keeps_what_can_stay(sizes, padding):
    packer, held = packing.Packer(64), {}
    for k, n in enumerate(sizes):
        window, offset = packer.put(n)
        held.setdefault(window, []).append((k, 0, n, n, window, offset, None, np.arange(n)))
    fills = packer.left_open()
    stay, (gaps, gone) = packing.closing(fills, packer.placed * padding, 64)
    assert sorted([*stay, *gone]) == sorted(fills) and all(fills[a] >= fills[b] for a in stay for b in gone)
    rows = [r for w in held if w not in gone for r in held[w]] + packing.refill([r for w in gone for r in held[w]], gaps, packer.next, 64)
    by = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        assert r[5] == by.get(r[4], 0)
        by[r[4]] = r[5] + r[2]
    assert sum(by.values()) == sum(sizes) and sum(64 - n for n in by.values() if n & (n - 1)) <= sum(sizes) * padding
    for k, n in enumerate(sizes):
        assert sorted(i + r[1] for r in rows if r[0] == k for i in range(r[2])) == list(range(n))


def test_most_ids_keep_the_place_the_rule_gave():
    draw = random.Random(2)
    packer = packing.Packer()
    for _ in range(1250):  # the documents of one of eight partitions at sf0.1
        packer.put(min(2048, int(draw.lognormvariate(6.3, 1)) + 1))
    fills = packer.left_open()
    _, (_, gone) = packing.closing(fills, packer.placed * packing.PADDING, 2048)
    assert sum(fills[w] for w in gone) < 0.05 * packer.placed


def test_simhash_equals_its_definition():
    text = "The quick\tbrown Fox\x0bjumps Ä over\u00a0the lazy dog the quick brown fox jumps"
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\x0b", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.majority([simhash.shingle_hashes(text, 4)])[0] == want
    assert simhash.majority([simhash.shingle_hashes(t, 4) for t in (None, "", " \n")]).tolist() == [0, 0, 0]
    assert simhash.shingle_hashes("One two", 4).tolist() == [xxhash.xxh64_intdigest(b"one two", 42)]


@pytest.mark.parametrize("m", simhash.LEVELS)
def test_close_pairs_share_a_block(m):
    rng = random.Random(m)
    masks = simhash.block_masks(m, 4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
        assert any(a & x == b & x for x in masks)


def test_bucket_links_connect_what_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(0, 1 << 63, 4, dtype=np.uint64).repeat(20)
        for _ in range(3):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        x = np.unique(x)

        def classes(pairs, n=len(x)):
            g = list(range(n))
            for i, j in pairs:
                a, b = g[i], g[j]
                g = [a if v == b else v for v in g]
            return [g.index(v) for v in g]

        at = {int(v): k for k, v in enumerate(x)}
        a, b = simhash._links_in_bucket(x, 4)
        near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
        assert classes((at[int(p)], at[int(q)]) for p, q in zip(a, b, strict=True)) == classes(near)
        assert len(a) < len(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=list("au\\\n<|im_start>ed"), max_size=12), st.text(alphabet=list("x\\\n<|im_start|>end"), max_size=30) | st.sampled_from([chat.START, chat.END, "<\\|im_end|>", "<\\\\|im_start|>"])), max_size=5))
def test_chat_reads_back(turns):
    rendered = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [p[:2] for p in chat.parse(rendered)] == turns
    for (_, text), (_, _, a, b) in zip(turns, chat.parse(rendered), strict=True):
        assert chat.unescape(rendered[a:b]) == text


def test_chat_leaves_harmless_text_alone():
    assert chat.render_turn("user", "a <| b \\ <|x|>")[0] == "<|im_start|>user\na <| b \\ <|x|><|im_end|>\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=12), max_size=4), st.integers(1, 9))
def test_windows_equal_brute_force(docs, least):
    h = np.array([a * 7919 + 13 for d in docs for a, _ in d], np.uint64)
    w = np.array([b for d in docs for _, b in d], np.int64)
    ends = np.cumsum([len(d) for d in docs]).astype(np.int64) if docs else np.empty(0, np.int64)
    start, end, at, content = linededup.windows(h, w, ends, least)
    want, base = [], 0
    for d in docs:
        runs = {(i, j) for i in range(len(d)) for j in range(i, len(d)) if sum(x for _, x in d[i : j + 1]) >= least}
        for i, j in sorted(runs):
            if ((i, j - 1) not in runs and d[i][1]) or ((i + 1, j) not in runs and d[j][1]):
                low = min(a for a, _ in d[i : j + 1])
                want.append((base + i, base + j, base + max(k for k in range(i, j + 1) if d[k][0] == low)))
        base += len(d)
    assert list(zip(start.tolist(), end.tolist(), at.tolist(), strict=True)) == want
    seen = {}
    for a, b, c in zip(start, end, content.tolist(), strict=True):
        assert seen.setdefault(c, h[a : b + 1].tolist()) == h[a : b + 1].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab .!?\n\x00é"), max_size=60))
def test_units_join_to_the_text(text):
    assert "".join(linededup.units_of(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=list("ab .!?\n\t\x00é日"), max_size=60), max_size=6))
def test_units_of_texts_end_to_end(texts):
    raw = [t.encode() for t in texts]
    begin, words, chars, per_text = linededup.cut_units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
    units = [linededup.units_of(t) for t in texts]
    flat = [u for us in units for u in us]
    assert per_text.tolist() == [len(us) for us in units] and words.tolist() == [len(u.encode().split()) for u in flat]
    assert chars.tolist() == [len(u) for u in flat] and begin.tolist() == np.cumsum([0, *(len(u.encode()) for u in flat)])[:-1].tolist()


def test_a_passage_is_cut_alike_wherever_it_stands():
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9)))
    short = 0
    for _ in range(300):
        passage = " ".join(word() for _ in range(55))
        a, b = (linededup.units_of(" ".join(word() for _ in range(draw.randint(3, 40))) + f" {passage} " + word()) for _ in range(2))
        shared = {u for u in a if u in b}
        short += sum(len(u.split()) for u in shared) < linededup.MIN_WORDS
    assert short <= 6  # two cuts in the outer 25 words


def test_adaptive_scan_finds_most_neighbours():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    q = x[:20] + 0.01
    hit = 0
    for bound in (np.inf, 9.0):
        found = ann.scan(q, x, q @ turn, x @ turn, 11, np.full(20, bound), ann.margins(64, 16, 0.001))
        for k, (at, far, read) in enumerate(found):
            d = np.sqrt(((x - q[k]) ** 2).sum(axis=1))
            assert np.allclose(far, d[at]) and read < x.size and far.max() <= bound
            near = [i for i in np.argsort(d)[:11] if d[i] <= bound]
            hit += len(set(near) & set(at.tolist())) / len(near)
    assert hit >= 0.95 * 40


def test_margins_are_quantiles():
    rng = np.random.default_rng(2)
    for d, share in ann.margins(64, 16, 0.01):
        x = rng.standard_normal((20_000, 64)) ** 2
        assert 0.005 < (x[:, :d].sum(axis=1) > share * x.sum(axis=1)).mean() < 0.02


def test_probes_follow_the_data():
    rng = np.random.default_rng(1)
    clustered = rng.standard_normal((40, 16)).repeat(50, axis=0) * 5 + rng.standard_normal((2000, 16))
    loose = rng.standard_normal((2000, 16))
    few, many = (ann.probes_for(x, ann.kmeans(x, 40), 10, 0.98) for x in (clustered, loose))
    assert few < 8 < many <= 40


def test_urls():
    assert urlfilter.split_url("HTTP://A.Org:80/Es/x?q#f") == ("a.org:80", "/Es/x")
    assert urlfilter.split_url(None) == urlfilter.split_url("no scheme") == ("", "")
    assert urlfilter.split_url("x://H#a/b") == ("h", "")
    rules = [urlfilter.host_rule("allow", "org", "/"), urlfilter.host_rule("block", "example.org", "/en/1"), *urlfilter.DEFAULT_PATTERNS]
    import re

    compiled = {r.pattern: re.compile(r.pattern) for r in rules}
    for url in ("http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/1", "http://example.org", "http://x.com/ads/1", "http://x.com/a?utm_source=b", "http://x.org/ads/", "http://x.net/a.ZIP", "http://x.net/signin?x", "http://ad.x.net/", "http://x.net/zip", None, ""):
        filed = urlfilter.index(rules, {"org": 9, "example": 3})
        host, path, rule, verdict = urlfilter.judge(url, filed, compiled)
        fits = [r for r in rules if r.name and host and (host == (h := r.name.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.name.partition("/")[2])]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert rule == (best.name if best else None)
        plain = "block" if any(compiled[r.pattern].search((url or "").lower()) for r in rules if not r.name) else "allow"
        assert verdict == (best.verdict if best else plain)


def test_a_rule_without_a_token_is_refused():
    with pytest.raises(ValueError, match="literal token"):
        urlfilter.index([urlfilter.pattern_rule("block", "a+")], {})


def test_sizes_as_settings_have_them():
    assert [common.size_of(t) for t in ("7", "16b", "2k", "64MB", "1g", "-1")] == [7, 16, 2048, 64 << 20, 1 << 30, -1]


def test_scratch_folders_must_be_shared():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,1024]"})()  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert "millrace-" in common.shared_dir(Session()) and common.shared_dir(Session()) == common.shared_dir(Session())


def test_quality_figures_and_trigrams_of_empty_texts():
    m = quality.Measure(b"good words here and there " * 20, b"!!! %%% &&& " * 40)
    assert m("") == m(None) == (0, 0, 0)
    assert np.isfinite(quality.figures(np.array([m(""), m("a"), m("good words here")]))).all()
    assert len(langid.trigrams(None)) == 0 and langid.letter_share("") == 0 and langid.letter_share("ab 12") == 0.5


@settings(max_examples=400, deadline=None)
@given(st.lists(texts | st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "<|endoftext|", "|endoftext|>"]), max_size=6))
def test_rank_file_gives_the_tokenizers_ids(parts):
    assert ENCODE("".join(parts)).tolist() == TOKENIZER.encode("".join(parts), add_special_tokens=False).ids


def test_rank_file_knows_the_added_tokens():
    assert {t.content: i for i, t in TOKENIZER.get_added_tokens_decoder().items()} == packing.ADDED
    assert ENCODE("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_both_dictionaries_come_from_all_samples():
    draw = random.Random(1)
    sample = lambda k: f"sample{k} ".encode() + " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(230)).encode()
    many, few = [sample(k) for k in range(1350)], [sample(k) for k in range(225)]
    for made in map(quality.dictionary, (many, few)):  # few: 317 KB, still trained, not the last 64 KB of it
        assert made[:4] == bytes.fromhex("37a430ec") and len(made) <= quality.DICTIONARY
    bad = quality.dictionary([b"short", b"short", few[0], few[1]])  # too few for the trainer: all that differ, whole
    assert bad == b" " * 16 + b"short" + few[0] + few[1] and quality.dictionary([]) == b" " * 16
