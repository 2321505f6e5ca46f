"""Bounded, deterministic samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: A sampled text has so many characters at most, so a sample of n rows takes 4 * n * LONGEST bytes on the driver at most.
LONGEST = 8_000
#: Of a longer one, as many passages as this, spread evenly over the whole text, are learned from.
PASSAGES = 8


def excerpt(text: Column) -> Column:
    """A text of LONGEST characters at most: itself, or its passages on lines of their own."""
    size = LONGEST // PASSAGES - 1
    starts = [F.floor((F.char_length(text) - size) * i / (PASSAGES - 1)).cast("int") + 1 for i in range(PASSAGES)]
    return F.when(F.char_length(text) <= LONGEST, text).otherwise(F.concat_ws("\n", *[F.substring(text, at, F.lit(size)) for at in starts]))


def sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> list[tuple[int, str]]:
    """(label, text) of up to per_class[label] rows each, those with the least hash of their id; rows of the held-out
    fold and rows without text or label are never taken. whole: of texts of LONGEST characters at most, for models whose
    features follow the length. Equal texts are taken once. Only ids of those rows and their excerpts reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), label.cast("int").alias("_label")).where("_label is not null and _id is not null")
    known = known.where(~held_out(F.col("_id"))).dropDuplicates(["_id"])
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where((F.char_length("_text") <= LONGEST) if whole else F.lit(True)).where(F.octet_length("_text") > 0)
    # The ids are chosen first, by hash; their number is bounded, and only their texts leave the executors.
    both = texts.select("_id").distinct().join(known, "_id")
    order = F.xxhash64("_id", F.lit(17))
    chosen = [r for value, most in per_class.items() for r in both.where(F.col("_label") == value).select("_id", "_label", order.alias("_o")).orderBy("_o", "_id").limit(most).collect()]
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(r["_id"], r["_label"], r["_o"]) for r in chosen], "_id long, _label int, _o long")
    rows = texts.join(F.broadcast(wanted), "_id").select("_label", "_o", "_id", excerpt(F.col("_text")).alias("_text")).distinct().collect()
    rows.sort(key=lambda r: (-r["_label"], r["_o"], r["_id"], r["_text"]))
    return list(dict.fromkeys((r["_label"], r["_text"]) for r in rows))
