"""Readers: tables, folders of books, recordings; listing rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def optional_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of that schema where there is none: a missing corpus does not stop a search."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def pruned(df: DataFrame, *names: str) -> DataFrame:
    """Those of the columns that the table has."""
    return df.select(*[c for c in names if c in df.columns])


BOOK_SUFFIXES = ("txt", "md", "epub", "pdf")


def book_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = BOOK_SUFFIXES) -> DataFrame:
    """path, length, modified and suffix of a folder's book files, hidden files and folders left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder).drop("content")
    relative = F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "")
    return found.where(~relative.rlike(r"(^|/)\.")).select("path", "length", F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix")).orderBy("path")


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text or Markdown file: path, text, markdown, and the key by the cascade front matter, first
    line, file name. Texts that are not UTF-8 or hold nothing are left out; refused_books() names them."""
    from lectern.functions import text as X

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(folder)
    books = raw.where(F.expr("is_valid_utf8(cast(content as string))")).select("path", F.col("content").cast("string").alias("raw")).where(F.length(F.trim("raw")) > 0)
    front = X.front_matter(F.col("raw"))
    body = X.without_front_matter(F.col("raw"))
    first = F.trim(F.get(F.filter(F.split(body, r"\R"), lambda x: F.length(F.trim(x)) > 0), F.lit(0)))
    first = F.regexp_replace(first, r"^#+\s*", "")
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    key = F.coalesce(X.front_matter_key(front), F.when(F.length(first) <= X.MAX_TITLE_LINE, X.split_title_author(first)), X.split_title_author(name), X.book_key(name, F.lit("")))
    return books.select("path", body.alias("text"), F.col("path").endswith(".md").alias("markdown"), key.alias("book"), F.sha2("raw", 256).alias("sha256"))


def refused_books(spark: SparkSession, folder: str) -> DataFrame:
    """path and problem of each text or Markdown file that read_books() leaves out. Files of no bytes are not among them:
    Spark's file sources pass over them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(folder)
    text = F.col("content").cast("string")
    problem = F.when(~F.expr("is_valid_utf8(cast(content as string))"), "not UTF-8").when(F.length(F.trim(text)) == 0, "holds nothing")
    return raw.select("path", problem.alias("problem")).where("problem is not null")


def read_recording(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Calls of a recorded run (JSON lines), one row per id and attempt with its replies in order. A header of another
    version is an error."""
    rows = spark.read.schema("kind string, schema_version int, id string, attempt int, call_index int, role string, raw string").json(path)
    other = rows.where((F.col("kind") == "header") & (F.col("schema_version") != version)).limit(1).count()
    if other:
        raise ValueError(f"{path}: recorded under another schema version than {version}")
    calls = rows.where("kind = 'call'").groupBy("id", "attempt").agg(F.sort_array(F.collect_list(F.struct("call_index", "role", "raw"))).alias("calls"))
    return calls


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir). A folder of our own is made
    only where none is set and all of Spark runs in this one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not context.isLocal():
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        found = context.getCheckpointDir().get()
    return f"{found}/lectern-{what}-{uuid.uuid4().hex}"
