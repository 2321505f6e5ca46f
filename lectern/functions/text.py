"""Column functions over strings: keys, labels, normalisation, redaction, sentences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators, limits and markers that keys, chunk ids and cut texts are made of.
SEPARATOR = " — "
UNKNOWN_AUTHOR = "Unknown"
UNTITLED = "full"
MAX_TITLE_LINE = 120
MAX_LABEL, LABEL_DIGEST, CUT_MARK = 500, 8, "… "
SLUG_CHARS, SLUG_DIGEST = 80, 8
CHUNK_TARGET = 2400
REDACTED = "[REDACTED-INJECTION]"

#: Control and invisible characters that are never text.
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F​-‏‪-‮⁦-⁩﻿]"

#: Lines that match one of these are redacted.
INJECTIONS = (
    r"ignore\s+(all\s+|any\s+)?(previous|above|prior|earlier)\s+instructions",
    r"disregard\s+(all\s+|any\s+)?(previous|above|prior)\s+",
    r"you\s+are\s+now\s+",
    r"new\s+instructions?\s*:",
    r"system\s+prompt\s*:",
    r"respond\s+only\s+with",
    r"do\s+not\s+follow\s+the\s+user",
    r"ігноруй\s+(всі\s+|усі\s+)?(попередні\s+)?інструкції",
)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_title(s: pd.Series) -> pd.Series:
    """Decomposed, case-folded, marks dropped, spaces collapsed: titles and authors are compared so."""

    def one(x: str) -> str:
        x = unicodedata.normalize("NFKD", x.replace("’", "'")).casefold()
        return " ".join("".join(c for c in x if not unicodedata.combining(c)).split())

    return s.map(one, na_action="ignore")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def compose(c: Column) -> Column:
    """NFKC. ASCII texts are composed already and never leave the JVM (Spark has no built-in)."""
    return F.coalesce(nfkc(F.when(F.octet_length(c) != F.char_length(c), c)), c)


def normalize(c: Column) -> Column:
    """The word sequence of a text: composed characters, lower case, punctuation but inside numbers as spaces, spaces
    collapsed."""
    c = strip_control(F.lower(compose(c)))
    # the mark is matched first, as most characters are none; look-behinds then see it too
    c = F.regexp_replace(c, r"[.,](?<=\p{Nd}.)(?=\p{Nd})", "\x01")
    c = F.regexp_replace(c, r"[-–−](?=\p{Nd})(?:(?<=\p{Nd}.)|(?<![\p{L}\p{N}].))", "\x02")
    c = F.regexp_replace(c, r"[^a-z\p{L}\p{N}\x01\x02]+", " ")
    return F.trim(F.replace(F.replace(c, F.lit("\x01"), F.lit(".")), F.lit("\x02"), F.lit("-")))


def token_count(normalized: Column) -> Column:
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " "))).cast("long")


def holds(haystack: Column, needle: Column) -> Column:
    """Whole-word contiguous containment of normalised texts."""
    return F.concat(F.lit(" "), haystack, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def redact(c: Column) -> Column:
    """Struct (text, redacted): lines that look like instructions to a model are replaced whole."""
    pattern = "(?iu)" + "|".join(INJECTIONS)
    lines = F.split(c, r"\r\n|[\r\n\x0B\x0C\x85  ]")
    return F.struct(
        F.array_join(F.transform(lines, lambda x: F.when(x.rlike(pattern), REDACTED).otherwise(x)), "\n").alias("text"),
        F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long").alias("redacted"),
    )


def book_key(title: Column, author: Column) -> Column:
    tidy = lambda c: F.trim(F.regexp_replace(strip_control(c), r"\s+", " "))
    return F.concat(tidy(title), F.lit(SEPARATOR), F.coalesce(F.nullif(tidy(author), F.lit("")), F.lit(UNKNOWN_AUTHOR)))


def title_of(key: Column) -> Column:
    return F.trim(F.regexp_extract(key, rf"(?s)^(.*?)(?:{SEPARATOR}(?:(?!{SEPARATOR}).)*)?$", 1))


def author_of(key: Column) -> Column:
    return F.when(key.contains(SEPARATOR), F.trim(F.substring_index(key, SEPARATOR, -1))).otherwise("")


def split_title_author(raw: Column) -> Column:
    """A key from 'Title — Author' (also other dashes) or 'Title by Author', split on the last separator; else null."""
    found = F.lit(None).cast("string")
    for pattern in (r"(?is)^(.+)\s+by\s+(\S.*)$", r"(?s)^(.+) - (.+)$", r"(?s)^(.+) -- (.+)$", rf"(?s)^(.+){SEPARATOR}(.+)$"):
        one, two = F.regexp_extract(F.trim(raw), pattern, 1), F.regexp_extract(F.trim(raw), pattern, 2)
        found = F.when((F.trim(one) != "") & (F.trim(two) != ""), book_key(one, two)).otherwise(found)
    return found


def slug(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.left(plain, F.lit(SLUG_CHARS)), F.lit("")), F.lit("book")), F.lit("-"), F.left(F.sha2(c, 256), F.lit(SLUG_DIGEST)))


def chunk_id(note: Column, section: Column, position: Column, ordinal: Column | None = None) -> Column:
    name = F.coalesce(F.nullif(section, F.lit("")), F.lit(UNTITLED))
    head = name if ordinal is None else F.concat(ordinal.cast("string"), F.lit("."), name)
    return F.concat(note, F.lit("#"), head, F.lit("/"), position.cast("string"))


def escape_marker(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))


def unescape_marker(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%7C"), F.lit("|")), F.lit("%25"), F.lit("%"))


def shorten_label(c: Column) -> Column:
    head = F.rtrim(F.left(c, F.lit(MAX_LABEL - len(CUT_MARK) - LABEL_DIGEST)))
    return F.when(F.char_length(c) <= MAX_LABEL, c).otherwise(F.concat(head, F.lit(CUT_MARK), F.left(F.sha2(c, 256), F.lit(LABEL_DIGEST))))


def sentences(c: Column) -> Column:
    """Sentences of a text; straight closing quotes and brackets at a boundary go with the boundary, curly ones stay."""
    parts = F.split(F.translate(c, "\n", " "), "(?<=[.!?…])[\"')\\]]*[ \\n]+")
    # a function of two arguments would get an element's place as what to trim
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def placed_chars(c: Column) -> Column:
    """Characters that packing places: those of the sentences."""
    return F.aggregate(sentences(c), F.lit(0).cast("long"), lambda n, x: n + F.char_length(x))


def chunk_floor(placed: Column) -> Column:
    """The least number of chunks that hold so many characters."""
    return F.ceil(placed / F.lit(CHUNK_TARGET)).cast("long")


def front_matter(c: Column) -> Column:
    """Map of a leading block between --- lines; empty without one."""
    block = F.regexp_extract(c, r"(?s)\A---\R(.*?)\R---\s*(?:\R|\z)", 1)
    lines = F.filter(F.split(block, r"\R"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[\w-]+\s*:\s*|[\"']", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\R.*?\R---[ \t]*(?:\R|\z)", "")


def front_matter_key(front: Column) -> Column:
    title = F.element_at(front, F.lit("title"))
    return F.when(F.length(title) > 0, book_key(title, F.coalesce(F.element_at(front, F.lit("author")), F.lit(""))))


def redact_urls(c: Column) -> Column:
    """Addresses without credentials, query and fragment."""
    c = F.regexp_replace(c, r"(?i)(https?://)[^/\s@]+@", "$1")
    return F.regexp_replace(c, r"(?i)(https?://[^\s?#]+)[?#][^\s]*", "$1")


def redact_paths(c: Column) -> Column:
    """Home folders in paths as ~."""
    return F.regexp_replace(c, r"(?:/home|/Users)/[^/\s:]+", "~")


def data_block(tag: str, text: Column, **attributes: Column) -> Column:
    """Text between tags of its own, with no way to close them from within: control characters go, < is neutralised."""
    head = [F.lit(f"<{tag}")]
    for name, value in attributes.items():
        head += [F.lit(f' {name}="'), F.regexp_replace(F.replace(strip_control(value), F.lit('"'), F.lit("'")), r"[<>\r\n]+", " "), F.lit('"')]
    return F.concat(*head, F.lit(">\n"), F.replace(strip_control(text), F.lit("<"), F.lit("‹")), F.lit(f"\n</{tag}>"))


def local_ref(c: Column) -> Column:
    """Struct (tag, path) of a reference local:<tag>:<path>; null for others."""
    parts = F.split(c, ":", 3)
    return F.when(c.startswith("local:") & (F.size(parts) == 3), F.struct(F.get(parts, F.lit(1)).alias("tag"), F.get(parts, F.lit(2)).alias("path")))
