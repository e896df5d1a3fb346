"""Samples of each format and what they must give, and round trips of any text."""

import time
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segloom.functions import text as X
from segloom.operators import render
from segloom.sources import formats, zipped

SRT = "1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\n\r\n \r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nTwo\r\nlines\r\n"
ASS = "[V4+ Styles]\nFormat: Name, Text\n[Events]\nFormat: Layer, Start, Text\nDialogue: 0,1,{\\an8}{\\b1}Hi, you\nComment: 0,1,no\nDialogue: 0\n"
LRC = "[ti:Song]\n[00:01.01]one\n[00:10.00][00:20.00]two\n[offset:5]x\n[12]no\n"


def blocks(spark, format_, source):
    df = spark.createDataFrame([(1, source)], "doc_id long, source string")
    return [tuple(b) for b in formats.parse(df, format_).first().blocks]


def test_txt(spark):
    got = blocks(spark, "txt", "[a]\r\nb\r　\n [c\nd\n")
    assert [(k, t) for k, _, t in got] == [("pass", "[a]"), ("text", "b"), ("pass", "　"), ("pass", " [c"), ("text", "d"), ("pass", "")]


def test_timed(spark):
    assert blocks(spark, "srt", SRT) == [("text", "1\n00:00:01,000 --> 00:00:02,000", "Hello"), ("text", "2\n00:00:03,000 --> 00:00:04,000", "Two\nlines")]
    assert [b[0] for b in blocks(spark, "vtt", "WEBVTT\n\nx --> y\nt\n\nNOTE a\nb\n\nu --> v")] == ["pass", "text", "pass", "text"]
    assert blocks(spark, "srt", "") == blocks(spark, "srt", "\n\n\n") == []


def test_ass(spark):
    got = [b for b in blocks(spark, "ass", ASS) if b[0] == "text"]
    assert got == [("text", "Dialogue: 0,1,{\\an8}{\\b1}", "Hi, you"), ("text", "Dialogue: 0", "")]
    n = spark.range(1).select(*[formats.commas_before_text(F.lit(x)) for x in ("a, Text, b", "Text, text", "a,b", "")]).first()
    assert list(n) == [1, 1, 1, 0]


def test_lrc(spark):
    got = [b for b in blocks(spark, "lrc", LRC) if b[0] == "text"]
    assert got == [("text", "[00:01.01]", "one"), ("text", "[00:10.00][00:20.00]", "two")]


def test_markdown():
    source = "---\na: 1\n---\n# Head\n\npara\nmore\n```rust\nx\n\n```  tail\n* * *\n\n---\n\n[x]: u\n\n[y]: v\nprose\n~~~\nopen"
    got = formats._markdown(source)
    assert [k for k, _ in got] == ["pass", "text", "pass", "text", "pass", "pass", "pass", "pass", "pass", "pass", "pass", "text", "pass"]
    assert "\n".join(t for _, t in got) == source
    assert [formats.is_rule(x) for x in ("---", "* * *", "___", "--", "-*-", "")] == [True, True, True, False, False, False]


def test_html(spark):
    html = "<head><title>t</title></head><body><nav><li>no</li></nav><blockquote><p>a<b>b</b></p>lost</blockquote><p>open<br><p>two</p><script>'</p>'</script><li> </li></body>"
    df = spark.createDataFrame([(html,)], "html string").select(formats.html(F.col("html")).alias("leaves"))
    assert [tuple(x) for x in df.first().leaves] == [("p", "ab"), ("p", "two")]
    assert [(t, x) for t, x, _ in zipped.leaves(html)] == [("p", "ab"), ("p", "two")]


def test_render_modes(spark):
    def out(format_, source, tr, mode):
        df = formats.parse(spark.createDataFrame([(source, tr)], "source string, tr map<bigint,string>"), format_)
        return df.select(render.render(format_, F.col("blocks"), F.col("tr"), mode)).first()[0]

    assert out("txt", "a\nb\n", {0: "A"}, "bilingual") == "a\nA\nb\n"
    assert out("md", "a\n\nb", {0: "A"}, "bilingual") == "a\n\nA\n\nb"
    assert out("srt", SRT, {0: "X"}, "replace") == "1\n00:00:01,000 --> 00:00:02,000\nX\n\n2\n00:00:03,000 --> 00:00:04,000\nTwo\nlines\n"
    assert "Hi, you\\NA\\NB" in out("ass", ASS, {4: "A\nB"}, "bilingual")
    assert out("lrc", "[0:1]a", {0: "x\ny"}, "bilingual") == "[0:1]a\n[0:1]x y"
    for format_ in ("epub", "docx"):
        with pytest.raises(ValueError):
            render.render(format_, F.col("b"), F.col("t"), "replace")


def test_epub_and_docx():
    book = zipped.epub_of([("a.xhtml", "<html><head></head><body><p>one</p><li>two &amp; 2</li></body></html>"), ("b.xhtml", "<p>three</p>")])
    assert zipped.epub_segments(book) == [(0, "one"), (1, "two &amp; 2"), (2, "three")]
    entries = zipped.members(zipped.epub_render(book, {1: "x < y"}))
    page = next(d for i, d in entries if i.filename.endswith("a.xhtml")).decode()
    assert entries[0][0].filename == "mimetype" and entries[0][0].compress_type == 0
    assert '<li>two &amp; 2</li><li class="hy-zh">x &lt; y</li>' in page and zipped.STYLE in page
    xml = f'<w:document xmlns:w="{zipped.WORDS}" xmlns:a="urn:a"><w:body><w:p><w:r><w:t>On</w:t></w:r><w:r><w:t>e</w:t></w:r></w:p><w:p/><w:p><a:p><a:t>no</a:t></a:p><w:t>b &amp; c</w:t></w:p></w:body></w:document>'
    assert [t for t, _ in zipped.paragraphs(xml.encode())] == ["One", "", "b & c"]
    doc = zipped.docx_of(["first", "", "third"])
    assert zipped.docx_segments(zipped.docx_render(doc, {1: "new\x07"})) == [(0, "first"), (1, "third"), (2, "new")]
    assert next(d for i, d in zipped.members(zipped.docx_render(doc, {}))) == next(d for i, d in zipped.members(doc))


TEXT = st.text(st.sampled_from("a -*_`~[]:#　é") | st.just("\n"), max_size=60)


@given(st.text(st.sampled_from("a-*_`~[]:#é\n"), max_size=60))  # a blank line's own blanks are not kept
@settings(max_examples=200, deadline=None)
def test_markdown_round_trip(source):
    assert "\n".join(t for _, t in formats._markdown(source)) == source


@given(st.lists(TEXT, min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_column_round_trips(spark, sources):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    none = F.create_map().cast("map<bigint,string>")
    for format_ in ("txt", "lrc"):
        out = formats.parse(df, format_).select("doc_id", render.render(format_, F.col("blocks"), none).alias("o")).collect()
        assert {r.doc_id: r.o for r in out} == dict(enumerate(sources))


@given(st.lists(st.text(st.sampled_from("ab .,日。\n"), max_size=80), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_text_functions(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = X.collapse_runs(F.col("t"))
    for r in df.select("t", X.split_boundary(F.col("t")).alias("h"), once.alias("c"), X.collapse_runs(once).alias("cc"), X.truncate_bytes(F.col("t"), 10).alias("cut")).collect():
        assert r.c == r.cc
        if r.h:
            assert r.h.left + r.h.right == r.t and r.h.left.strip() and r.h.right.strip()
        assert r.cut == r.t if len(r.t.encode()) <= 10 else len(r.cut[:-1].encode()) <= 10 and r.t.startswith(r.cut[:-1])


def _halves(t: str) -> tuple[str, str] | None:
    marks = [i for i, c in enumerate(t) if c in X.BOUNDARIES]
    if not marks:
        return None
    cut = min(marks, key=lambda i: (abs(i - len(t) // 2), i))
    while cut < len(t) and t[cut] in X.BOUNDARIES:
        cut += 1
    return (t[:cut], t[cut:]) if t[:cut].strip() and t[cut:].strip() else None


def test_split_boundary_plain_and_long(spark):
    texts = ["", " ", "a", "ab", "a b", ".a", "a.", "ab cd", "aaaa b", "a bbbb", "a, b.. c", "日本。語、文🙂 x", "a" * 50, "x \\^-] y", *("".join(p) for n in range(1, 6) for p in product("a .", repeat=n))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.split_boundary(F.col("t")).alias("h")).collect():
        assert (tuple(r.h) if r.h else None) == _halves(r.t), r.t
    # a mark in every second place: the work grows with the text, not with its marks times its length
    began = time.monotonic()
    got = spark.range(1).select(F.expr("repeat('a ', 300000)").alias("t")).select(X.split_boundary(F.col("t")).alias("h")).select(F.length("h.left"), F.length("h.right")).first()
    assert tuple(got) == (300_000, 300_000)
    assert time.monotonic() - began < 30
