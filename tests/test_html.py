"""HTML to text: cases by hand, whole pages against a plain walk."""

import time
from html import unescape
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolesieve.functions import html as functions_html
from rolesieve.functions.html import html_to_text, sections_text

PAGES = Path("/root/testdata/sf0.001/pages.parquet")


# Page text and what a reader sees of it, written down case by case.
CASES = [
    (None,
     None),
    ('',
     None),
    ('   ',
     None),
    ('<p></p>',
     None),
    ('plain',
     'plain'),
    ('<p>Hello <b>big</b> world .</p>',
     'Hello big world.'),
    ('<b>P</b>ython',
     'P ython'),
    ('a<5 and b <c> d',
     'a < 5 and b d'),
    ('1 < 2 > 0',
     '1 < 2 > 0'),
    ('<p>Join R&D</p>',
     'Join R&D'),
    ('<script>var t="</p>";a&&b &amp; c</script><p>x',
     'var t="</p>";a&&b &amp; c x'),
    ('<style>p{a:"<b>"}</style>x',
     'p{a:"<b>"} x'),
    ('<script>if (a < b) { }</script><p>x &amp; y</p><script>c && d</script>',
     'if (a < b) { } x & y c && d'),
    ('<!-- a > b -->t',
     't'),
    ('<a title="x>y">z</a>',
     'z'),
    ('<a title=\'it "q" > y\'>z</a>',
     'z'),
    ('&lt;b&gt;x &copy; &nbsp;y',
     '<b>x © y'),
    ('&#39;q&#x27; &#233; &#8364; &#128; &#0; &#xD800; &#1114112; &#x1F600;',
     "'q' é € € � � � 😀"),
    ('&eacute;&eacute &notit; &ampx; &amp;eacute; &unknown; & &; &#; &#x; a&b=c&copy=1',
     'éé ¬it; &x; &eacute; &unknown; & &; &#; &#x; a&b=c©=1'),
    ('café\xa0\u2003x\u3000, y \x1c z',
     'café x, y z'),
    ('x<br/>y<br>z',
     'x y z'),
    ('<?pi x>r</ foo>s<!DOCTYPE html>t',
     'r s t'),
    ('<script/>x<b>y</b>z',
     'x y z'),
    ('&NotEqualTilde; &fjlig; &#x80; &#x81; &#13;a &#1;b &#xFFFE;c',
     '≂̸ fj € \x81 a b c'),
    ('&#99999999999999999999; &#x0000000041; &#0000000000065; &amp &lt;',
     '� A A & <'),
    ('&#xFFFFFFFFF; & amp; &é; &amp;',
     '� & amp; &é; &'),
    ('😀 &amp; 😁 : z',
     '😀 & 😁: z'),
]


def seen(page):
    """Visible text of a well-formed page, by a walk from sign to sign."""
    at, words = 0, []
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            words += unescape(page[at:end]).split()
        elif page.startswith("<!--", at):
            end = page.index("-->", at) + 3
        else:
            end = page.index(">", at) + 1
            name = page[at + 1:end - 1].split(" ")[0]
            if name in ("script", "style"):
                close = page.index(f"</{name}>", end)
                words += page[end:close].split()
                end = close
        at = end
    text = " ".join(words)
    for mark in ".,!?;:":
        text = text.replace(" " + mark, mark)
    return text


def test_cases(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, h string")
    got = {r.i: r.t for r in rows.select("i", html_to_text("h").alias("t")).collect()}
    for i, (h, text) in enumerate(CASES):
        assert got[i] == text, h


@pytest.mark.skipif(not PAGES.exists(), reason="needs the shared test tables")
def test_whole_pages(spark):
    rows = spark.read.parquet(str(PAGES)).select("html", html_to_text("html").alias("t")).collect()
    assert rows
    for r in rows:
        assert r.t == seen(r.html)


def test_long_text_does_not_exhaust_the_stack(spark):
    big = "<p class=\"a\">" + "word &eacute; " * 50_000 + "</p>" + "<script>" + "x && y;" * 50_000 + "</script>"
    tag = "<a " + "data-x='1' " * 5_000 + ">t</a>"
    rows = spark.createDataFrame([(big + tag,)], "h string")
    assert rows.select(html_to_text("h").alias("t")).first().t == "word é " * 50_000 + "x && y;" * 50_000 + " t"


def test_sections(spark):
    def run(main, sections):
        df = spark.createDataFrame([(main, sections)],
                                   "m string, s array<struct<heading:string,content:string>>")
        return df.select(sections_text("m", F.col("s")).alias("t")).first().t

    assert run("<p>About</p>", [(" What you do ", "<li>Build</li>"), (None, "x"), ("Empty", "<p> </p>")]) \
        == "About\n\nWhat you do: Build\n\nx"
    assert run(None, [("H", "b")]) == "H: b"
    assert run("", None) is None
    assert run(None, []) is None


@pytest.mark.parametrize("piece", ["<!--x", "<script>x & ", "<STYLE >y", "<a ", "<a \"", "</a "])
def test_long_pages_of_brackets_without_an_end(spark, piece):
    """A search from each bracket to the end of the page would take minutes here."""
    page = spark.createDataFrame([("<p>one</p><script>a</script>two" + piece * (400_000 // len(piece)),)], "html string")
    begun = time.monotonic()
    text = page.select(html_to_text("html")).first()[0]
    assert time.monotonic() - begun < 20 and text.startswith("one a two")


@pytest.mark.parametrize("html, text", [
    ("<!--x><b>y<!--z", "y <!--z"), ("<script>a<script>b", "a b"), ("<style>x</style><style>y & <b", "x y & < b"),
    ("<!-- <style> --><script> x </style> a&amp;b </script>", "x </style> a&amp;b"), ("a < b <c", "a < b < c"),
])
@pytest.mark.parametrize("long", [0, 1 << 30])
def test_marked_brackets_read_like_others(spark, monkeypatch, html, text, long):
    monkeypatch.setattr(functions_html, "_LONG", long)
    assert spark.createDataFrame([(html,)], "html string").select(html_to_text("html")).first()[0] == text
