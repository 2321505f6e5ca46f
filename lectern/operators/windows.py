"""A window of a long text around what a query asks for, with marks for what is left out at either end.

Words are compared as normalised tokens that remember where in the raw text they stand, so the window is cut from the raw
text. Of all runs of query words that fit the window's width the best covers the most different words, then has the
better mix of them (counts in rising order), then is the shorter, then the earlier. Work is one pass a text."""

from __future__ import annotations

import re
import unicodedata
from bisect import insort
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import CONTROL

from .provenance import JOINER

# The marks for what is left out after and before a window.
_TAIL = "\n[chapter continues: {} characters not shown]"
_HEAD = "[chapter begins earlier: {} characters not shown]\n"
_TAIL_FOUND = re.compile(r"\n?\[chapter continues: (\d+) characters not shown\]\s*$")
_HEAD_FOUND = re.compile(r"^\s*\[chapter begins earlier: (\d+) characters not shown\]\n?")

_RUN = re.compile(r"\S+")
_WORD_AND_GAP = re.compile(r"\S*\s*")
_CONTROL = re.compile(CONTROL)
_POINT = re.compile(r"(?<=\d)[.,](?=\d)")
_DASH = re.compile(r"(?<=\d)[-–−](?=\d)|(?<![^\W_])[-–−](?=\d)")


@lru_cache(1 << 14)
def words(run: str) -> list[str]:
    """The normalised words of a run of characters without white space, as functions.text.normalize() has them."""
    text = _CONTROL.sub("", unicodedata.normalize("NFKC", run).lower())
    if text.isalnum() and text.isascii():
        return [text]
    text = _DASH.sub("\x02", _POINT.sub("\x01", text))
    kept = "".join(c if c in "\x01\x02" or unicodedata.category(c)[0] in "LN" else " " for c in text)
    return kept.replace("\x01", ".").replace("\x02", "-").split()


class Token(NamedTuple):
    """A normalised word, where its raw run starts and ends, and the part of the text (between joiners) that it is in."""

    word: str
    start: int
    end: int
    part: int


def tokens(text: str, wanted: set[str] | None = None) -> list[Token]:
    """All tokens of a text, or those of wanted words."""
    out, offset = [], 0
    for k, part in enumerate(text.split(JOINER)):
        for run in _RUN.finditer(part):
            out.extend(Token(w, offset + run.start(), offset + run.end(), k) for w in words(run.group()) if wanted is None or w in wanted)
        offset += len(part) + len(JOINER)
    return out


class _Mix:
    """Counts of the words in a run, and the same counts in rising order."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.rising: list[int] = []

    def change(self, word: str, by: int) -> None:
        old = self.of.get(word, 0)
        if old:
            self.rising.remove(old)
        if old + by:
            insort(self.rising, old + by)
        self.of[word] = old + by


def densest(text: str, query: str, width: int) -> tuple[int, int] | None:
    """Where the best run of query words in the text starts and ends; None if none fits."""
    wanted = {w for run in _RUN.finditer(query) for w in words(run.group())}
    hits = tokens(text, wanted)
    mix, last, best = _Mix(), 0, None
    for first, hit in enumerate(hits):
        while last < len(hits) and hits[last].end - hit.start <= width:
            mix.change(hits[last].word, 1)
            last += 1
        if last <= first:  # one run that is wider than all of the window
            last = first + 1
            continue
        size = hits[last - 1].end - hit.start
        key = (len(mix.rising), list(mix.rising), -size)
        if best is None or key > best[0]:
            best = (key, (hit.start, hit.start + size))
        mix.change(hit.word, -1)
    return best and best[1]


class Window(NamedTuple):
    text: str
    #: which characters of the whole text it shows
    start: int
    end: int
    #: characters of the whole text, and of those that could be chosen from
    whole: int
    seen: int


def _inward(body: str, start: int, end: int) -> tuple[int, int]:
    """The span without the words that its ends cut."""
    if 0 < start < len(body) and not body[start - 1].isspace():
        start = _WORD_AND_GAP.match(body, start).end()
    if 0 < end < len(body) and not body[end].isspace():
        head = body[:end]
        end = len(head.rstrip()) if head[-1].isspace() else len(head.rsplit(None, 1)[0]) if len(head.split(None, 1)) > 1 else 0
    return start, end


def around(text: str, query: str, budget: int, verbatim: bool = False) -> Window:
    """budget characters of a text, marks included, around the best run of the query's words; with verbatim, around the
    first place that holds the query letter by letter, if one does and fits (words of a quote can stand denser elsewhere).

    A text that fits is returned whole. One that was cut before ends with a mark, whose number counts as characters not
    shown. Without any of the query's words, and where the window begins with the text, it is the text's head."""
    cut = _TAIL_FOUND.search(text)
    body, beyond = (text[: cut.start()], int(cut[1]) + len(cut[0])) if cut else (text, 0)
    whole = len(body) + beyond
    if not cut and len(text) <= budget:
        return Window(text, 0, len(text), whole, len(body))
    # room for both marks with the largest numbers that they can have
    width = max(1, budget - len(_HEAD.format(len(body))) - len(_TAIL.format(whole)))
    at = body.find(query) if verbatim and 0 < len(query) <= width else -1
    found = (at, at + len(query)) if at >= 0 else densest(body, query, width)
    start = 0
    if found:
        start = max(0, found[0] - max(0, width - (found[1] - found[0])) // 2)
    end = min(len(body), start + width)
    start, end = _inward(body, max(0, end - width), end)
    if end <= start:  # a word longer than the window
        start = min(start, len(body))
        end = min(len(body), start + width)
    if start == 0:
        mark = _TAIL.format(whole - budget) if whole > budget else ""
        shown = body[: max(0, budget - len(mark))]
        return Window(shown + mark, 0, len(shown), whole, len(body))
    mark = _TAIL.format(whole - end) if whole > end else ""
    return Window(_HEAD.format(start) + body[start:end] + mark, start, end, whole, len(body))


def without_marks(text: str) -> str:
    return _HEAD_FOUND.sub("", _TAIL_FOUND.sub("", text))


_TYPE = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start", "end", "whole", "seen")]])


def window(text: Column, query: Column, budget: int, verbatim: bool = False) -> Column:
    """Struct (text, start, end, whole, seen) of around(); null text or query count as empty."""

    @F.pandas_udf(_TYPE)
    def cut(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([around(a or "", b or "", budget, verbatim) for a, b in zip(t, q)], columns=_TYPE.names)

    return cut(text, query)
