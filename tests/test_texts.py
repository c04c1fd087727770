"""Masking against plain validators, and HTML to text against the standard library's parser."""

from html.parser import HTMLParser

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import markup, masking
from tests.compare import compare


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail a.b+c@mail.example.com, now", "mail [EMAIL], now"),
        ("4111 1111 1111 1111 and 4111111111111112", "[CARD] and 4111111111111112"),
        ("pay 4111-1111-1111-1111.", "pay [CARD]."),
        ("GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432 or GB83WEST12345698765432", "[ACCOUNT] or [ACCOUNT] or GB83WEST12345698765432"),
        ("10.0.0.255 but 10.0.0.256 and 1.2.3", "[ADDRESS] but 10.0.0.256 and 1.2.3"),
        ("call +1 (017) 555-7713 or 017-555-7713", "call [PHONE] or [PHONE]"),
        ('token = "b44e15e09fd311c3cf3163b66d5a9875" password: aaaaaaaaaa', 'token = "[SECRET]" password: aaaaaaaaaa'),
        ("secret=4111111111111111x@mail.example.com", "secret=[EMAIL]"),
        ("né 10.1.1.1 😀 a@b.cd", "né [ADDRESS] 😀 [EMAIL]"),
        ("", ""),
    ],
)
def test_masks(text, want):
    masked, spans = masking.mask(text)
    assert masked == want
    for (a, b, _), (c, _, _) in zip(spans, spans[1:]):
        assert a < b <= c


def test_checksums():
    assert masking.luhn("79927398713") and not masking.luhn("79927398710")
    assert masking.mod97("DE89370400440532013000") and not masking.mod97("DE88370400440532013000") and not masking.mod97("DE89")
    assert masking.entropy("aaaa") == 0 and masking.entropy("abcd") == 2


spans = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9), st.sampled_from(sorted(masking.KINDS))).map(lambda t: (t[0], t[0] + t[1], t[2])), max_size=12)


@given(spans)
@settings(max_examples=300, deadline=None)
def test_sweep_keeps_what_no_kept_span_before_it_overlaps(found):
    order = list(masking.KINDS)
    kept = masking.resolve(found)
    left, want = sorted(found, key=lambda s: (s[0], -s[1], order.index(s[2]))), []
    while left:  # plainly: take the first, drop all that overlap it
        want.append(left[0])
        left = [s for s in left[1:] if s[0] >= want[-1][1]]
    assert kept == want


@pytest.mark.parametrize("text", ["a" * 300_000, "a." * 150_000, "1 " * 150_000, "1." * 150_000, "token=" * 50_000, "4111 " * 60_000, "a@" * 150_000, "A1" * 150_000])
def test_masking_is_linear(text):
    import time

    began = time.time()
    masking.mask(text)
    assert time.time() - began < 10


def test_masking_odd_rows(spark):
    rows = [(1, None, 5, "m"), (None, "", 5, "m"), (2, "x@y.zz", 5, "m"), (2, "x@y.zz", 5, "m"), (3, "w " * 200_000 + "x@y.zz", 5, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, masked string")
    got = [(r["doc_id"], r["masked"] if r["doc_id"] != 3 else r["masked"][-7:], [tuple(s) for s in r["spans"]]) for r in masking.mask_texts(df, ["doc_id", "spans"]).collect()]
    assert sorted(got, key=str) == sorted([(1, None, []), (None, "", []), (2, "[EMAIL]", [(0, 6, "EMAIL")]), (2, "[EMAIL]", [(0, 6, "EMAIL")]), (3, "[EMAIL]", [(400_000, 6, "EMAIL")])], key=str)
    assert masking.mask_texts(df.limit(0), ["doc_id"]).count() == 0


class Reference(HTMLParser):
    """The standard library's tokens in the form of ours."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag))

    def handle_startendtag(self, tag, attrs):
        self.seen.append(("start", tag))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        self.seen.append(("text", data))


def joined(tokens):
    """Neighbouring texts as one; how a text is cut into tokens says nothing. Texts of raw elements are left out."""
    out, raw = [], None
    for kind, value in tokens:
        if kind == "start":
            raw = value if value in markup.RAW else None
        elif kind == "end":
            raw = None
        if kind == "text" and (raw or not value):
            continue
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        else:
            out.append((kind, value))
    return out


def reference(html):
    parser = Reference()
    parser.feed(html)
    parser.close()
    return joined(parser.seen)


pieces = st.sampled_from([
    "<p>", "</p>", "<b class='x>y'>", "</b>", "<br/>", "<a href=\"a>b\">", "</a>", "text ", "a &amp; b", "&lt;i&gt;", "&#65;", "&eacute;", "<!-- c > -->", "<!DOCTYPE html>", "1 < 2 ", "<div\n id=x>", "</DIV>", "<H1>",
    "</h1>", "<script>var a = '<p>' && b;</script>", "<style>p{}</style>", "<img src=x alt=\"<\">", "é", "\n", "<ul><li>", "<td>", "<?xml ?>", " 3 > 2",
])


@given(st.lists(pieces, max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_tokens_equal_the_standard_librarys(html):
    assert joined(markup.tokens(html)) == reference(html)


def test_tokens_of_the_tables_pages_equal_the_standard_librarys(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        assert joined(markup.tokens(r["html"])) == reference(r["html"])


@pytest.mark.parametrize("html,want", [
    ("a<b", ["a"]), ("a<!-- b", ["a"]), ("a<script>b", ["a"]), ("a <p title='x", ["a"]), ("<", ["<"]), ("a</", ["a"]), ("<title>x</title>y", ["x", "y"]), ("<textarea><p>&amp;</textarea>", ["<p>&"]), (None, []), ("", []), ("  \n", []),
    ("<p>a<p>b<li>c", ["a", "b", "c"]), ("a<script>x</SCRIPT>b", ["ab"]), ("<p>a <i>b</i>\n c</p>", ["a b c"]),
])
def test_blocks_of_broken_pages(html, want):
    assert [t for _, t, _ in markup.blocks(html)] == want


def test_content_is_told_from_navigation(spark):
    long = "This is a long enough sentence to be the content of a page. " * 3
    page = f"<html><head><title>T</title></head><body><nav><a href=/a>{long}</a></nav><h1>Head</h1><p>{long}</p><h2>Other</h2><p>short</p><div>{long} <a>more</a></div></body>"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (2, None, "x")], "page_id long, html string, text string")
    got = markup.html_texts(df, ["page_id", "text"]).orderBy("page_id").collect()
    assert got[0]["title"] == "T" and got[0]["content"].split("\n") == ["Head", long.strip(), long + "more"] and got[0]["n_blocks"] == 6
    assert tuple(got[1]) == tuple(got[2]) == (2, None, "", "", 0)
    assert markup.html_texts(df.limit(0), ["page_id"]).count() == 0


def test_long_pages_are_read_in_linear_time():
    import time

    began = time.time()
    for html in ("<" * 200_000, "<a href='" * 50_000, "<!--" * 50_000, "<p " * 50_000, "&amp" * 50_000, "<script>" * 50_000, "<p>x" * 100_000, "</" * 100_000, "<a b=c d=\"e\"" * 20_000):
        markup.blocks(html)
    assert time.time() - began < 20


def test_pages_decode_the_references_of_their_sql(spark, tmp_path):
    """References that were cut, that have no `;` or that titles don't decode, as in titles cut at a length."""
    pages = ["<html><head><title>a &amp;&amp</title></head><body><h1>b &amp;&am</h1><p>c &amp &copy; &copy d&middot;&quot;</p></body></html>", "<title>say &quot;x&lt;y&amp;lt;</title><p>&nbsp;q&amp;quot;&#65;&gt;&lt</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/t")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/t/*.parquet'")
    spark.read.parquet(f"{tmp_path}/t").write.parquet(f"{tmp_path}/pages.parquet")
    compare(markup.text_of_pages(spark, str(tmp_path)), con, markup._TAGS)
    assert markup.blocks("<p>a &amp b &copy</p>") == [("p", "a & b ©", 0)]  # the tokenizer by itself keeps to the standard
