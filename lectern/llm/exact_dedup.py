"""Exact deduplication by content-defined chunk recipes; DataFrame functions only.

A text (A-Z lowered, null as empty) is cut at places that its content names: after a sentence end or line break, at
least MIN_CHUNK characters after the last cut. Equal chunks get one identifier (64-bit hash and length), which one
pass verifies: all chunks under it are compared by content, and where two differ, the recipes that use that
identifier carry their text's SHA-256 as well. Texts are equal when their recipes, the ordered lists of
identifiers, are equal; so long texts move once, as chunks, and all later shuffles carry recipes.

Of equal texts the largest doc_id stays. Rows that repeat a doc_id share its fate. A null doc_id never stays while
its group has another. Extra columns are ignored; an empty table gives an empty result. Groups are reduced by
partial aggregation and joined back (large groups are split by adaptive execution), never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

MIN_CHUNK, MAX_CHUNK = 512, 8192


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text's content-defined chunks; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:[.!?]\s|\n)|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.struct(F.xxhash64(chunk).alias("h"), F.octet_length(chunk).alias("len"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, ident=identifier) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 and n_chunks."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("norm"))
    recipes = materialize(
        texts.select(
            "doc_id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm"), least), ident).alias("recipe"),
        ),
        "recipes",
    )
    parts = texts.select(F.explode(chunks(F.col("norm"), least)).alias("chunk"))
    unsound = (
        parts.groupBy(ident(F.col("chunk")).alias("id")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
        .where("lo <> hi").select("id")
    )
    # rows are told apart by their text's digest here, as ids may repeat
    doubtful = (
        recipes.select("text_sha256", F.explode(F.array_distinct("recipe")).alias("id")).join(unsound, "id", "left_semi")
        .groupBy("text_sha256").agg(F.lit(True).alias("doubtful"))
    )
    keyed = recipes.join(doubtful, "text_sha256", "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("doubtful"), F.col("text_sha256")).otherwise("").alias("witness")
    )
    groups = keyed.groupBy("recipe", "witness").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return keyed.join(groups, ["recipe", "witness"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks")
    )


#: n_chunks is left out of the query: the SQL has no chunks.
ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
