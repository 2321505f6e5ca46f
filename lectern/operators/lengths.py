"""How long the rows of a table are, against what its chunker can make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segment import OVERLAP, TARGET

#: The longest chunk that packing makes.
CEILING = TARGET + OVERLAP


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Per group: n, median, p95 and longest of rows (group, length). Floor-index percentiles from counts by length, so no
    group's values are gathered."""
    counts = rows.groupBy(by, "length").agg(F.count("*").alias("k"))
    group = Window.partitionBy(by)
    upto = counts.withColumns({"upto": F.sum("k").over(group.orderBy("length")), "n": F.sum("k").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col("length")))
    return upto.groupBy(by).agg(F.max("n").alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("length").alias("longest"))


def over_ceiling(rows: DataFrame, by: str) -> DataFrame:
    """Per group with any: how many rows (group, length) no chunk can be, and the longest."""
    return rows.where(F.col("length") > CEILING).groupBy(by).agg(F.count("*").alias("over_ceiling"), F.max("length").alias("longest"))
