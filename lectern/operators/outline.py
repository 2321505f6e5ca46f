"""Parts, chapters and outlines: what stands at an offset belongs to the last heading before it.

Matching is as-of and backward: marks and points of a key are put in one order and each point takes the last mark
before it, so there is no range join. The order is cut into spans, each sorted by itself, and a span takes over the last mark
of the spans before it; so one very long key is many tasks' work."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import SEPARATOR

#: Offsets of a key that are sorted together.
SPAN = 1_000_000

_HEADINGS = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("title", T.StringType())]))


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], or_at: bool = False, span: int = SPAN) -> DataFrame:
    """Points (keys, at, others) with mark: the value of the last of the marks (keys, at, value) of their key that stands before
    them (or_at: or at the same offset), null if there is none. Of marks at one offset the greatest value is the last.
    Null keys are a key; a point or mark without an offset meets nothing, and the point is kept."""
    names = points.columns
    rows = points.select(*keys, "at", F.lit(1 if or_at else -1).alias("_kind"), F.struct(*names).alias("_point"), F.lit(None).cast(marks.schema["value"].dataType).alias("_value"))
    both = rows.unionByName(marks.where("at is not null and value is not null").select(*keys, "at", F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_point"].dataType).alias("_point"), F.col("value").alias("_value")))
    both = both.withColumn("_span", F.expr(f"at div {span}"))
    inside = Window.partitionBy(*keys, "_span").orderBy("at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).where("_point is not null")
    ends = marks.where("at is not null and value is not null").withColumn("_span", F.expr(f"at div {span}")).groupBy(*keys, "_span").agg(F.max(F.struct("at", "value")).alias("_end"))
    spans = both.where("_span is not null").select(*keys, "_span").distinct()
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    held = spans.join(ends, same(spans, ends, [*keys, "_span"]), "left").select(*[spans[c] for c in (*keys, "_span")], F.col("_end.value").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null").drop("_end")
    out = found.join(carried, same(found, carried, [*keys, "_span"]), "left")
    return out.select("_point.*", F.coalesce("_last", "_carried").alias("mark"))


def headings(text: Column, pattern: str) -> Column:
    """Array (at, title) of whole-line headings: a group of the pattern selects the title, else it is the line."""
    found = re.compile(pattern, re.M)
    title = lambda m: re.sub(r"\s+", " ", m.group(1) if m.re.groups else m.group()).strip(" .*")

    @F.pandas_udf(_HEADINGS)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"at": m.start(), "title": title(m)} for m in found.finditer(t or "")])

    return of(text)


def chapters_in_parts(books: DataFrame, chapter: str, part: str) -> DataFrame:
    """(note, at, chapter, part, title) of the chapter headings of books (note, text): title is 'part — chapter', so that
    chapters whose numbers begin anew in each part are told apart. Only offsets and titles move."""
    each = lambda pattern, name: books.select("note", F.inline(headings(F.col("text"), pattern))).withColumnRenamed("title", name)
    placed = last_before(each(chapter, "chapter"), each(part, "value"), ["note"]).withColumnRenamed("mark", "part")
    return placed.withColumn("title", F.concat(F.coalesce(F.concat("part", F.lit(SEPARATOR)), F.lit("")), "chapter"))


def sections_of_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Pages (note, page) with section: the outline's entry (note, page, title, ordinal) that begins on the page or was the
    last to begin before it; of entries that begin on one page the last."""
    marks = outline.select("note", F.col("page").alias("at"), F.struct("ordinal", "title").alias("value"))
    found = last_before(pages.withColumn("at", F.col("page").cast("long")), marks.withColumn("at", F.col("at").cast("long")), ["note"], or_at=True)
    return found.select(*pages.columns, F.col("mark.title").alias("section"))
