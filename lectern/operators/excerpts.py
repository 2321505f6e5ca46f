"""Openings of a book's chapters under a budget: in order, each that still fits is taken, and one that does not is
passed over for the next.

The rule is sequential, so a book's openings are read in order by one task, which keeps a sum and a batch; bodies do
not move, and what is taken of a book is bounded by its budget. Chapters that share book and n follow by title and
opening. Null or blank bodies have no opening; a null book is a book."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import _strip

# Characters of an opening, and of a book's openings.
EACH, TOTAL = 1500, 60_000


def openings(chapters: DataFrame, each: int = EACH, total: int = TOTAL) -> DataFrame:
    """The openings (book, n, title, opening) that are taken of chapters (book, n, title, body)."""
    rows = chapters.select("book", "n", "title", _strip(F.substring("body", 1, each)).alias("opening"))
    # what cannot fit at all does not move
    rows = rows.withColumn("size", F.char_length("opening")).where((F.col("size") > 0) & (F.col("size") <= total))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, spent = None, -1  # of no book yet
        for batch in batches:
            kept = []
            for book, size in zip(batch["key"], batch["size"], strict=True):
                if spent < 0 or book != now:
                    now, spent = book, 0
                kept.append(spent + size <= total)
                spent += size * kept[-1]
            yield batch[pd.Series(kept, index=batch.index, dtype=bool)]

    # a null book is told from an empty one
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("book").cast("string")), F.lit("")))
    ordered = rows.repartition("key").sortWithinPartitions("key", "n", "title", "opening")
    return ordered.mapInPandas(take, ordered.schema).drop("size", "key")


def excerpts(chapters: DataFrame, each: int = EACH, total: int = TOTAL) -> DataFrame:
    """Per book with openings: chapters_read, and its excerpts, each opening under its chapter's title."""
    taken = F.array_sort(F.collect_list(F.struct("n", "title", "opening")))
    text = F.transform(taken, lambda t: F.concat(F.lit("### "), F.coalesce(t["title"], F.lit("")), F.lit("\n"), t["opening"]))
    return openings(chapters, each, total).groupBy("book").agg(F.count("*").alias("chapters_read"), F.array_join(text, "\n\n").alias("excerpts"))
