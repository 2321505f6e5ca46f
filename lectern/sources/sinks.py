"""Sinks over Parquet folders: staged publishing, upserts, recovery, digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoRows(ValueError):
    """A rebuild that would publish nothing; the table stays as it was."""


class Store:
    """Tables under one folder. A table is a folder of versions and a pointer, which is replaced in one rename, so
    readers see the old version or the new one and a crash leaves the old."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def current(self, name: str) -> str | None:
        """The folder that holds the table's rows now."""
        pointers = self._at(name, "current")
        if not self._fs.exists(pointers):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(pointers))
        return f"{self.root}/{name}/{names[-1].split('@')[1]}" if names else None

    def read(self, name: str) -> DataFrame | None:
        at = self.current(name)
        return self.spark.read.parquet(at) if at else None

    def replace(self, name: str, rows: DataFrame) -> int:
        """Publish rows as the whole table; returns their number, counted in what was written."""
        version = f"v-{uuid.uuid4().hex}"
        staged = f"{self.root}/{name}/{version}"
        rows.write.parquet(staged)
        n = self.spark.read.parquet(staged).count()
        if not n:
            self._fs.delete(self._path(staged), True)
            raise NoRows(name)
        self._fs.mkdirs(self._at(name, "current"))
        had = [s.getPath() for s in self._fs.listStatus(self._at(name, "current"))]
        last = max([int(p.getName().split("@")[0]) for p in had], default=0)
        aside = self._at(name, f".pointer-{uuid.uuid4().hex}")
        self._fs.create(aside).close()
        if not self._fs.rename(aside, self._at(name, "current", f"{last + 1:012d}@{version}")):
            raise OSError(f"{name}: the pointer could not be moved")
        for p in had:
            self._fs.delete(p, False)
        return n

    def recover(self, name: str) -> list[str]:
        """Delete versions that no pointer names (a crash before publishing, or after it); returns them."""
        keep = (self.current(name) or "").rpartition("/")[2]
        if not self._fs.exists(self._at(name)):
            return []
        gone = [s.getPath() for s in self._fs.listStatus(self._at(name)) if s.getPath().getName().startswith(("v-", ".pointer-")) and s.getPath().getName() != keep]
        for p in gone:
            self._fs.delete(p, True)
        return [p.getName() for p in gone]

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Replace the rows that have one of the new rows' keys (any of the columns equal), and append."""
        return self.replace(name, upserted(self.read(name), rows, keys))


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that share no key column's value with a new row, and the new rows: one anti-join for each column, so
    the condition 'this or that' needs no nested loop."""
    if old is None:
        return new
    columns = old.columns
    for k in keys:
        old = old.join(new.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return old.select(*columns).unionByName(new, allowMissingColumns=True)


def backfilled(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with book_id (by note; '' if unknown) and book_rev ('')."""
    return rows.join(ids.select("note", "book_id").dropDuplicates(["note"]), "note", "left").withColumns({"book_id": F.coalesce("book_id", F.lit("")), "book_rev": F.lit("")})


#: Files of a manifest whose listing is digested at once; a listing takes about 100 bytes a file.
MOST_FILES = 1_000_000


def directory_digest(files: DataFrame) -> DataFrame:
    """One digest of (path, sha256) rows: SHA-256 of the sorted lines, a file's digest and path on each. The digest is of
    one text, so a manifest has MOST_FILES files at most; a larger one is an error."""
    small = files.agg(F.count("*").alias("n")).where(F.when(F.col("n") > MOST_FILES, F.raise_error(F.lit("too many files for one digest"))).otherwise(F.lit(True)).cast("boolean"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("  "), x["path"])), "\n")
    return files.join(F.broadcast(small)).agg(F.sha2(lines, 256).alias("digest"), F.count("*").alias("files"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing, changed or unexpected."""
    both = expected.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
