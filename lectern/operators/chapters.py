"""Reading chapters back from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINER = "\n[...]\n"


def line_chunks(docs: DataFrame) -> DataFrame:
    """Lines of documents as chunk rows (book, chunk_id, text)."""
    lines = docs.select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("book", F.concat(F.col("book").cast("string"), F.lit("#full/"), "n").alias("chunk_id"), "text")


def position(chunk_id: Column) -> Column:
    """The number behind the last slash; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(chunk_id, r"/(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))


def join_chunks(chunks: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """Per chapter: its chunks in order, with a joiner between them, cut to a limit. A chapter is one row by its
    nature, so its chunks are gathered."""
    parts = F.array_sort(F.collect_list(F.struct(position(F.col("chunk_id")).alias("n"), "chunk_id", "text")))
    out = chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), JOINER).alias("body"), F.count("*").alias("chunks"))
    return out.withColumn("body", head_cut(F.col("body"), limit)) if limit else out


def capped(chunks: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each chapter, in order."""
    w = Window.partitionBy(*keys).orderBy(position(F.col("chunk_id")), "chunk_id")
    return chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def by_variant(asked: DataFrame, sections: DataFrame, patterns: list[str]) -> DataFrame:
    """The section that each asked name means: the first pattern that gives one."""
    tries = F.array(*[F.struct(F.lit(i).cast("long").alias("variant"), F.concat(F.lit(p.split("{}")[0]), F.col("asked"), F.lit(p.split("{}")[1])).alias("section")) for i, p in enumerate(patterns)])
    found = asked.select("asked", F.inline(tries)).join(sections, "section")
    best = found.groupBy("asked").agg(F.min_by("section", "variant").alias("section"), F.min("variant").alias("variant"))
    return asked.join(best, "asked", "left")


def head_cut(text: Column, budget: int) -> Column:
    hidden = (F.char_length(text) - budget).cast("string")
    return F.when(F.char_length(text) <= budget, text).otherwise(F.concat(F.left(text, F.lit(budget)), F.lit("\n[... "), hidden, F.lit(" more characters]")))


def is_cut(text: Column) -> Column:
    return text.rlike(r"\n\[\.\.\. \d+ more characters\]\z")
