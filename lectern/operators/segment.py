"""Documents into sections and chunks; HTML into paragraphs. Sequential rules run as Arrow functions, a document a row."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes of chunks, and the names of sections without a title of their own.
TARGET, OVERLAP, LONGEST_SENTENCE, LEAST_CHAPTER = 2400, 240, 2000, 200
WHOLE, FRONT = "Full text", "Front matter"
#: Fixed value: whole lines that are chapter headings.
HEADING = (
    r"^(?:(?:CHAPTER|Chapter|BOOK|Book|LETTER|Letter|STAVE|ADVENTURE)\s+(?:[IVXLCDM]+|[0-9]+)\b[^\n]{0,80}"
    r"|THE [A-Z]+ BOOK|[IVXL]+\.\s+[A-Z][A-Z '’,;-]{3,70}\.?)$"
)
_MARKDOWN = re.compile(r"^(#{1,2})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_BOUNDARY = re.compile(r"(?<=[.!?…])[\"')\]]*[ \n]+")

SECTIONS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _BOUNDARY.split(text.replace("\n", " "))) if s]


def pieces_of(sentence: str) -> Iterator[str]:
    """Slices of at most LONGEST_SENTENCE characters, cut at white space where there is any."""
    while len(sentence) > LONGEST_SENTENCE:
        at = sentence.rfind(" ", 1, LONGEST_SENTENCE + 1)
        at = at if at > 0 else LONGEST_SENTENCE
        if head := sentence[:at].strip():
            yield head
        sentence = sentence[at:].strip()
    if sentence:
        yield sentence


def pack(parts: list[str]) -> list[str]:
    """Chunks of whole sentences, TARGET characters at most with the spaces between; the next chunk begins with the
    last whole sentences of the one before that fit in OVERLAP and leave room for the sentence that comes."""
    chunks: list[str] = []
    held: list[str] = []
    size = 0
    for s in (p for x in parts for p in pieces_of(x)):
        if held and size + 1 + len(s) > TARGET:
            chunks.append(" ".join(held))
            tail: list[str] = []
            length = 0
            for t in reversed(held):
                if length + len(t) + bool(tail) > OVERLAP:
                    break
                length += len(t) + bool(tail)
                tail.insert(0, t)
            held, size = (tail, length) if length + bool(tail) + len(s) <= TARGET else ([], 0)
        size += len(s) + bool(held)
        held.append(s)
    if held:
        chunks.append(" ".join(held))
    return chunks


def unique_titles(titles: list[str]) -> list[str]:
    """Titles told apart by ' (N)', so that no name that comes out occurs twice."""
    taken, out, turn = set(titles), [], {}
    used: set[str] = set()
    for t in titles:
        name = t
        while name in used or (name != t and name in taken):
            turn[t] = turn.get(t, 1) + 1
            name = f"{t} ({turn[t]})"
        used.add(name)
        out.append(name)
    return out


def chapters(text: str, heading: str = HEADING, least: int = LEAST_CHAPTER, preamble: bool = False) -> list[tuple[str, str]]:
    """(title, body) by whole-line headings; bodies shorter than least (lines of a contents page) are dropped."""
    found = list(re.finditer(heading, text, re.M))
    out = []
    if preamble and found and text[: found[0].start()].strip():
        out.append((FRONT, text[: found[0].start()].strip()))
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(text)]):
        body = text[m.end() : end].strip()
        if len(body) >= least:
            out.append((re.sub(r"\s+", " ", m.group()).strip(" ."), body))
    return out


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """Sections by # and ## lines; a single # line that leads is the text's title, what precedes headings is kept."""
    found = list(_MARKDOWN.finditer(text))
    tops = [m for m in found if m.group(1) == "#"]
    if len(tops) == 1 and found and found[0] is tops[0] and not text[: tops[0].start()].strip():
        text, found = text[: tops[0].start()] + " " * (tops[0].end() - tops[0].start()) + text[tops[0].end() :], found[1:]
    out = []
    lead = text[: found[0].start()].strip() if found else text.strip()
    if lead:
        out.append((FRONT if found else WHOLE, lead))
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(text)]):
        out.append((m.group(2), text[m.end() : end].strip()))
    return out


def merged_contents(sections: list[tuple[str, str]], least: int = LEAST_CHAPTER) -> list[tuple[str, str]]:
    """A short section whose title comes again later is a contents line: it joins the section before it."""
    out: list[tuple[str, str]] = []
    for i, (title, body) in enumerate(sections):
        if len(body) < least and any(title == t for t, _ in sections[i + 1 :]):
            line = f"{title}\n{body}".strip()
            if out:
                out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{line}")
            else:
                out.append((FRONT, line))
        else:
            out.append((title, body))
    return out


def book_sections(text: str, markdown: bool) -> list[tuple[str, str]]:
    """Markdown headings, else chapter headings, else the whole text; short contents lines merged, titles unique."""
    found = markdown_sections(text) if markdown else chapters(text, least=0, preamble=True)
    found = merged_contents(found) or [(WHOLE, text.strip())]
    return list(zip(unique_titles([t for t, _ in found]), [b for _, b in found]))


def _each(f, returns):
    return F.pandas_udf(lambda s: s.map(lambda x: f(x or "")), returns)


def sections(text: Column, markdown: bool = False) -> Column:
    return _each(lambda x: [{"title": t, "body": b} for t, b in book_sections(x, markdown)], SECTIONS)(text)


def chunks(text: Column) -> Column:
    return _each(lambda x: pack(sentences(x)), T.ArrayType(T.StringType()))(text)


def chunk_rows(books: DataFrame) -> DataFrame:
    """Chunk rows (note, section, chunk_id, text) of books (note, text): one row in, its chunks out, no shuffle."""
    from lectern.functions.text import chunk_id

    parts = books.select("note", F.posexplode(sections(F.col("text"))).alias("ordinal", "s"))
    each = parts.select("note", "ordinal", F.col("s.title").alias("section"), F.posexplode(chunks(F.col("s.body"))).alias("n", "text"))
    return each.select("note", "section", chunk_id(F.col("note"), F.col("section"), F.col("n"), F.col("ordinal")).alias("chunk_id"), "text")


class _Paragraphs(HTMLParser):
    # Elements whose text is not read, and elements that end a paragraph.
    SKIP = {"script", "style", "head", "title", "svg", "math", "noscript", "template", "object", "iframe", "button", "select", "textarea"}
    BREAK = {"p", "div", "section", "article", "aside", "header", "footer", "nav", "main", "blockquote", "pre", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "caption", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "br", "address", "body", "html"}

    VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        #: elements open within one that is skipped, that one first, and for each name where it was opened
        self.skipped: list[str] = []
        self.opened: dict[str, list[int]] = defaultdict(list)

    def end(self) -> None:
        if text := " ".join("".join(self.line).split()):
            self.out.append(text)
        self.line = []

    def close_to(self, tag: str) -> None:
        """Close the innermost open element of that name and all that is open in it; places of elements that others
        have closed are stale, and are met once."""
        places = self.opened[tag]
        while places:
            at = places.pop()
            if at < len(self.skipped) and self.skipped[at] == tag:
                del self.skipped[at:]
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body":  # ends a head that nothing else did
            while "head" in self.opened and self.skipped and self.opened["head"]:
                self.close_to("head")
        if self.skipped or tag in self.SKIP:
            if tag not in self.VOID:
                self.opened[tag].append(len(self.skipped))
                self.skipped.append(tag)
        elif tag in self.BREAK:
            self.end()

    def handle_startendtag(self, tag, attrs):
        if tag == "body":
            self.handle_starttag(tag, attrs)
        elif not self.skipped and tag in self.BREAK:
            self.end()

    def handle_endtag(self, tag):
        if self.skipped:
            self.close_to(tag)
        elif tag in self.BREAK:
            self.end()

    def handle_data(self, data):
        if not self.skipped:
            self.line.append(data)


def html_paragraphs(html: Column) -> Column:
    def one(markup: str) -> list[str]:
        p = _Paragraphs()
        p.feed(markup)
        p.close()
        p.end()
        return p.out

    return _each(one, T.ArrayType(T.StringType()))(html)


def html_links(html: Column) -> Column:
    """Addresses of links, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


#: Fixed value: the characters that are spaces (Unicode's Zs).
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def between_markers(text: Column, name: Column | None = None) -> Column:
    """The text between the first line that starts a distributed file and the first line after it that ends it (lines of
    that name, where one is given); all of it without a line that starts. Spaces at both ends are left out."""
    named = F.lit("") if name is None else F.concat(F.lit(" "), name)
    lines = F.concat(F.lit("\n"), text)
    start = F.position(F.concat(F.lit("\n*** START OF"), named), lines)
    marked = F.substr(lines, start + 1)
    # begins with the line's end, so that a line that ends the file may follow at once
    body = F.when(F.contains(marked, F.lit("\n")), F.substr(marked, F.position(F.lit("\n"), marked))).otherwise("")
    inner = F.call_function("substring_index", body, F.concat(F.lit("\n*** END OF"), named), F.lit(1))
    return F.trim(F.when(start > 0, F.substr(inner, F.lit(2))).otherwise(text), F.lit(SPACES))


def furniture(docs: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, line) of lines of three words to 90 characters that a document repeats: running heads and feet."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.char_length("line") <= 90) & (F.size(F.split("line", " +")) >= 3))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


# A card's section longer than the first is split into pieces of up to the second.
CARD_LIMIT, CARD_TARGET = 2000, 1400


def card_pieces(section: str) -> list[str]:
    """A long section of a card cut before bullets and ### lines, packed."""
    if len(section) <= CARD_LIMIT:
        return [section] if section.strip() else []
    out = [""]
    for part in re.split(r"\n(?=[-*] |### )", section):
        joined = f"{out[-1]}\n{part}" if out[-1] else part
        if out[-1] and len(joined) > CARD_TARGET:
            out.append(part)
        else:
            out[-1] = joined
    return [x.strip() for x in out if x.strip()]


def follows(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether section number b can come right after a: its next sibling, first child, or an elder's next sibling."""
    if len(b) == len(a) + 1:
        return b[:-1] == a and b[-1] == 1
    return 0 < len(b) <= len(a) and b[:-1] == a[: len(b) - 1] and b[-1] == a[len(b) - 1] + 1


def numbered_chain(headings: list[tuple[int, tuple[int, ...]]]) -> list[int]:
    """Places of the longest run of consecutively numbered headings (place, number); of equal runs the first."""
    best: list[tuple[int, int]] = []
    for i, (_, number) in enumerate(headings):
        before = [(best[j][0], -j) for j in range(i) if follows(headings[j][1], number)]
        length, j = max(before, default=(0, 1))
        best.append((length + 1, -j))
    if not best:
        return []
    at = max(range(len(best)), key=lambda i: (best[i][0], -i))
    chain = []
    while at >= 0:
        chain.append(headings[at][0])
        at = best[at][1]
    return chain[::-1]
