"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). One of our own is made only where none is set and all of
    Spark runs in this one process, as in tests; on a cluster a missing setting is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java_dir.isDefined():
        return java_dir.get()
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lectern-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. remove() takes the table away once nothing reads it."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with arrow_bytes(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table that materialize() wrote."""
    hadoop_fs, path = hadoop(df.sparkSession, df.written_to)
    hadoop_fs.delete(path, True)


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20):
    """Arrow batches of that many bytes (or one row) at most for what runs inside, so that a worker's memory does not
    follow the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. Texts of one-byte characters take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def numbered(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """The rows with _i, from 0 within their group by ascending order (nulls first), and _n, the group's size; written to the
    shared folder. Rows are range-partitioned by group and order, so that a large group is spread over many tasks, and
    numbered by their place in a partition and the rows of the partitions before it. rows should be a written table, as
    ranges are sampled from it first. Names that begin with an underscore are taken."""
    placed = rows.repartitionByRange(*[F.col(c) for c in (group, *order)]).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), what).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    parts = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first",
        (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("_n"),
    )
    found = placed.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_i"), "_n")
