import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B

CASES = [
    # items, terms and nesting
    ("<ul><li>a<ul><li>b <b>c</b></li></ul>d</li><li><p>e</p></li></ul>", None, [("item", 0, "a"), ("item", 0, "b c"), ("text", 0, "d"), ("text", 0, "e")]),
    ("<dl><dt>word</dt><dd>meaning</dd></dl>", None, [("term", 0, "word"), ("text", 0, "meaning")]),
    # headings, line breaks, entities
    ("<h1>One \n two</h1>x &amp; y  <br>z<h3><div>inner</div></h3>", None, [("heading", 1, "One two"), ("text", 0, "x & y\nz"), ("text", 0, "inner")]),
    # code keeps its lines
    ("<pre># x\n\n  y </pre>", None, [("code", 0, "# x\n\n  y ")]),
    # quotations, their headings and code
    ("<blockquote><p>a</p><h2>b</h2><li>c</blockquote>d", None, [("quote", 0, "a"), ("heading", 2, "b"), ("quote", 0, "c"), ("text", 0, "d")]),
    # tables; one within another has rows of its own
    ("<table><tr><th>k</th><th>v</th></tr><tr><td></td><td> </td></tr></table>", None, [("row", 0, "| k | v |")]),
    ("<table><tr><td>a</td><td>t<table><tr><td>b</td></tr></table></td></tr></table>", None, [("text", 0, "t"), ("row", 0, "| b |"), ("row", 0, "| a |  |")]),
    # elements that are not read, closed by what is around them
    ("<p>a<nav><p>menu</nav>b<script>x<p>y</script><p>c<form><b></form>d", None, [("text", 0, "a"), ("text", 0, "b"), ("text", 0, "c"), ("text", 0, "d")]),
    # containers: by name, id and class; each of them; unclosed elements end with them
    ("no<main>in<p>side</main>no<main>again</main>", "main", [("text", 0, "in"), ("text", 0, "side"), ("text", 0, "again")]),
    ("<div id=x>no</div><div id=y><div>deep</div>yes</div>no", "div#y", [("text", 0, "deep"), ("text", 0, "yes")]),
    ("<i class='a b'>yes</i><i class=ab>no</i>", ".b", [("text", 0, "yes")]),
    ("<main>open", "main", [("text", 0, "open")]),
    ("<p>none</p>", "article", []),
    ("", None, []),
]


@pytest.mark.parametrize("markup,container,want", CASES)
def test_runs(markup, container, want):
    assert B.runs(markup, container) == want


def by_regex(markup):
    """Well-formed markup of p, h2, li, pre and b, told by splitting at borders."""
    out, pieces = [], re.split(r"(</?(?:p|h2|li|pre)>)", markup)
    for before, text in zip([None, *pieces[1::2]], pieces[0::2], strict=True):
        text = re.sub(r"</?b>", "", text)
        kind = {"<h2>": "heading", "<li>": "item", "<pre>": "code"}.get(before, "text")
        text = text.strip("\n") if kind == "code" else " ".join(text.split())
        if text:
            out.append((kind, 2 * (kind == "heading"), text))
    return out


def test_random_pages():
    rng = random.Random(5)
    for _ in range(2000):
        parts = []
        for i in range(rng.randint(0, 8)):
            inner = f"w{i}" + rng.choice(["", " <b>x</b>", "\n y", "<b></b> "])
            tag = rng.choice(["p", "h2", "li", "pre", None])
            parts.append(f"<{tag}>{inner}</{tag}>" if tag else inner)
        assert B.runs("".join(parts)) == by_regex("".join(parts)), parts


def test_markdown(spark):
    page = "<h1>2. Start</h1><p>## no heading<br>#tag</p><h6>deep</h6><blockquote>q<br>r</blockquote><pre># c\n\nd</pre><ul><li>i</ul><dl><dt>t</dl>"
    df = spark.createDataFrame([(1, page, "start"), (2, None, "x"), (3, "", None)], "id long, html string, title string")
    got = {r.id: r for r in df.select("id", B.blocks(df.html).alias("b"), "title").select("id", B.render(F.col("b"), 1, F.col("title")).alias("m")).collect()}
    assert got[1].m == "    ## no heading\n#tag\n\n###### deep\n\n> q\n> r\n\n    # c\n\n    d\n\n- i\n\n**t**"
    assert got[2].m is None and got[3].m == ""


def test_first_heading_and_links(spark):
    page = '<h2>b</h2><h1>a</h1><h1>c</h1><a class=x href="/u?a=1&amp;b=2">t <i>u</i>&nbsp;&lt;</a><a name=n>no</a><A HREF="z"></A>'
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert [r[0] for r in df.orderBy("id").select(B.first_heading(B.blocks(df.html))).collect()] == ["a", None]
    assert [tuple(r) for r in B.links(df, df.html, "id").orderBy("n").collect()] == [(1, 0, "/u?a=1&b=2", "t u <"), (1, 1, "z", "")]
