"""HTML pages as Markdown blocks: a small parser finds the runs of text of a page, and column functions render them.

A run is the text between two borders, which are the starts and ends of block elements. It takes its kind from the
block element whose start it follows directly: a heading (with level), an item, a term or code; other runs are text,
and runs in a quotation are quotes. A table row is one run of its cells. `container` (tag, tag#id or tag.class) limits
reading to the elements that match it. An end tag closes the innermost open element of its name and all that is open
in it, so unclosed elements neither hide what follows nor keep it out. Null pages have no blocks (null), empty ones an
empty list. Memory is bounded by a page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import same_heading

# Elements that are not read, that have no content, and that border runs; the kinds that an element's
# first run takes; the indentation of code.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "svg", "noscript", "sup", "iframe", "button", "select", "object", "picture", "video", "audio"}
VOID = {"br", "img", "hr", "input", "meta", "link", "col", "source"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "dl", "table", "tr", "figure", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "td", "th", "figcaption", "main"}
KINDS = {"li": "item", "dt": "term", "pre": "code", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
INDENT = "    "
SCHEMA = "array<struct<kind string, level int, text string>>"


def selector(spec: str):
    """A test of (tag, attributes) for tag, tag#id or tag.class; the tag may be left out before # and ."""
    tag, mark, name = re.fullmatch(r"([^#.]*)([#.]?)(.*)", spec, re.S).groups()

    def test(found: str, attrs: dict[str, str]) -> bool:
        if tag and found != tag:
            return False
        return not mark or (attrs.get("id") == name if mark == "#" else name in attrs.get("class", "").split())

    return test


class _Runs(HTMLParser):
    def __init__(self, container: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted = selector(container) if container else None
        self.runs: list[tuple[str, int, str]] = []
        self.open: list[str] = []
        self.within: Counter[str] = Counter()
        #: depths at which the container and a skipped element begin
        self.begin, self.hidden = (None, None) if container else (0, None)
        self.first: str | None = None  # the block element of which nothing has been read yet
        self.text: list[str] = []
        self.rows: list[list[str]] = []

    @property
    def reading(self) -> bool:
        return self.begin is not None and self.hidden is None

    def border(self, first: str | None = None) -> None:
        text = re.sub(r"[ \t]+\n", "\n", "".join(self.text))
        kind = KINDS.get(self.first, "text")
        text = text.strip("\n") if self.within["pre"] else text.strip()
        if text:
            if kind != "heading" and self.within["blockquote"]:
                kind = "quote"
            if kind in ("heading", "item", "term"):
                text = " ".join(text.split())
            self.runs.append((kind, int(self.first[1]) if kind == "heading" else 0, text))
        self.text, self.first = [], first

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.reading:
                self.text.append("\n")
            return
        if self.reading:
            if tag in SKIPPED:
                self.border()
                self.hidden = len(self.open)
            elif tag in BLOCKS:
                self.border(tag)
                if tag == "tr":
                    self.rows.append([])
        elif self.begin is None and self.wanted(tag, {k: v or "" for k, v in attrs}):
            self.begin = len(self.open)
        self.open.append(tag)
        self.within[tag] += 1

    def handle_endtag(self, tag):
        if not self.within[tag]:
            if self.reading and tag in BLOCKS:
                self.border()
            return
        while self.leave() != tag:
            pass

    def leave(self) -> str:
        """Close the innermost open element."""
        tag = self.open[-1]
        if self.reading:
            if tag in ("td", "th") and self.rows:
                self.rows[-1].append(" ".join("".join(self.text).split()))
                self.text, self.first = [], None
            elif tag in BLOCKS or len(self.open) - 1 == self.begin and self.wanted:
                self.border()
            if tag == "tr" and self.rows and any(row := self.rows.pop()):
                self.runs.append(("row", 0, "| " + " | ".join(row) + " |"))
        self.open.pop()
        self.within[tag] -= 1
        if self.hidden == len(self.open):
            self.hidden = None
        elif self.wanted and self.begin == len(self.open):
            self.begin, self.rows = None, []
        return tag

    def handle_data(self, data):
        if self.reading:
            self.text.append(data if self.within["pre"] else re.sub(r"\s+", " ", data))


def runs(markup: str, container: str | None = None) -> list[tuple[str, int, str]]:
    parser = _Runs(container)
    parser.feed(markup)
    parser.close()
    if parser.begin is not None:
        parser.border()
    return parser.runs


#: A sign of an entity that does not end in a semicolon.
_OPEN = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)")


def blocks(html: Column, container: str | None = None, closed_entities: bool = False) -> Column:
    """Blocks (kind, level, text) of a page in order. closed_entities: what looks like an entity and has no semicolon is
    text; otherwise those that HTML allows so are resolved."""

    def prepared(page: str) -> str:
        return _OPEN.sub("&amp;", page) if closed_entities else page

    @F.pandas_udf(SCHEMA)
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else [dict(zip(("kind", "level", "text"), r, strict=True)) for r in runs(prepared(p), container)])

    return read(html)


def markdown(block: Column) -> Column:
    """A block's Markdown, headings without their marks. No line of it can be read as a heading of level 1 or 2."""
    kind, text = block["kind"], block["text"]
    code = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(r"\S"), F.concat(F.lit(INDENT), line)).otherwise(line)), "\n")
    body = (
        F.when(kind == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .when(kind == "item", F.concat(F.lit("- "), text)).when(kind == "term", F.concat(F.lit("**"), text, F.lit("**"))).when(kind == "code", code).otherwise(text)
    )
    return F.when(kind == "heading", text).otherwise(F.regexp_replace(body, r"(^|\n)(#{1,2}[ \t])", f"$1{INDENT}$2"))


def render(found: Column, demote: int = 0, skip_title: Column | None = None) -> Column:
    """Blocks as one Markdown text. Headings are at level 2 + demote or deeper, 6 at most; a first heading that names
    the same as skip_title is left out."""

    def one(block: Column, at: Column) -> Column:
        level = F.least(F.lit(6), F.greatest(block["level"] + demote, F.lit(demote + 2)))
        heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), block["text"])
        if skip_title is not None:
            heading = F.when((at == 0) & F.coalesce(same_heading(block["text"], skip_title), F.lit(False)), F.lit(None)).otherwise(heading)
        return F.when(block["kind"] == "heading", heading).otherwise(markdown(block))

    return F.regexp_replace(F.array_join(F.transform(found, one), "\n\n"), r"\A\n+|\n+\z", "")


def first_heading(found: Column, level: int = 1) -> Column:
    """The text of the first heading of that level, or null."""
    return F.get(F.filter(found, lambda b: (b["kind"] == "heading") & (b["level"] == level)), F.lit(0))["text"]


def unescaped(text: Column) -> Column:
    """Texts with their entities resolved."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else unescape(t)), "string")(text)


def links(pages: DataFrame, html: Column, *keys: str) -> DataFrame:
    """The pages' links in order: keys, n (from 0), href and text, with entities resolved and tags taken out of texts."""
    anchor = r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'
    found = pages.select(*keys, F.posexplode(F.arrays_zip(*[F.regexp_extract_all(html, F.lit(anchor), F.lit(i)).alias(name) for i, name in ((1, "href"), (2, "text"))])).alias("n", "a"))
    text = F.regexp_replace(unescaped(F.regexp_replace("a.text", "<[^>]+>", " ")), r"(?U)\s+", " ")
    return found.select(*keys, "n", unescaped("a.href").alias("href"), F.trim(text).alias("text"))
