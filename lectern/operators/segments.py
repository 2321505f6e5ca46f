"""A BM25 index that follows its documents: segments, tombstones and a manifest.

A segment holds the postings of some documents and is never changed. Replacing or deleting documents writes a segment of
the new ones and tombstones (segment, doc_id, dl) for the old; the manifest that names segments and tombstones is published in
one step, so a reader sees all of a change or none, and a crash leaves files that recover() deletes. When FANIN segments
are of one size class, or half of a segment is dead, they are merged from their postings without a text being read again.
So a change costs its own documents and, over time, a logarithm of the corpus; untouched segments are not rewritten.

Rankings are those of an index built anew: the numbers of documents and words leave out dead ones, and a term's document
frequency is counted in its live postings, which a query reads anyway. Null texts are documents without words; of rows
that repeat a doc_id in one change the longest text stays, then the last by its bytes."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.sinks import Store

from . import retrieval as R

FANIN = 4
#: Documents from which a segment leaves the smallest size class; each class is FANIN times as large.
LEAST = 1000
_ROWS = "segment string, n long, words long, doc_id long, dl long"
_POSTINGS = "term string, doc_id long, dl int, tf long, segment string"


class SegmentedIndex:
    """An index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def exists(self) -> bool:
        return self.store.current("manifest") is not None

    def manifest(self) -> DataFrame:
        """Segments (segment, n, words: as written) and tombstones (segment, doc_id, dl)."""
        found = self.store.read("manifest")
        return self.spark.createDataFrame([], _ROWS) if found is None else found

    def segments(self) -> list[tuple[str, int, int, int]]:
        """(segment, documents, words, dead documents); their number is bounded by merging."""
        dead = F.count("doc_id")
        rows = self.manifest().where("segment <> ''").groupBy("segment").agg(F.max("n"), F.max("words"), dead).collect()
        return sorted(tuple(r) for r in rows)

    def dead(self) -> DataFrame:
        return self.manifest().where("doc_id is not null").select("segment", "doc_id", "dl")

    def _read(self, part: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/segments/{s}/{part}" for s in names])

    def _live(self, part: str, names: list[str], schema: str) -> DataFrame:
        return self._read(part, names, schema).join(self.dead(), ["segment", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        """(doc_id, dl, segment) of the documents that the index holds."""
        return self._live("documents", [s for s, *_ in self.segments()], "doc_id long, dl int, segment string")

    def _publish(self, segments: DataFrame, dead: DataFrame) -> None:
        none = F.lit(None).cast("long")
        head = self.spark.createDataFrame([("", 0, 0, None, None)], _ROWS)
        rows = head.union(segments.select("segment", "n", "words", none, none)).union(dead.select("segment", none, none, "doc_id", F.col("dl").cast("long")))
        self.store.replace("manifest", rows.coalesce(1) if not dead.take(1) else rows)

    def _write(self, postings: DataFrame, documents: DataFrame) -> tuple[str, int, int] | None:
        """A new segment of postings (term, doc_id, dl, tf) and documents (doc_id, dl); nothing if there are no documents."""
        name = uuid.uuid4().hex
        at = f"{self.root}/segments/{name}"
        documents.select("doc_id", "dl", F.lit(name).alias("segment")).write.parquet(f"{at}/documents")
        n, words = self._read("documents", [name], "doc_id long, dl int, segment string").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return None
        dealt = postings.select("term", "doc_id", "dl", "tf", F.lit(name).alias("segment")).repartition("term", F.pmod(F.xxhash64("doc_id"), F.lit(R.SPREAD)))
        dealt.sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        return name, n, words

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Put documents (doc_id, text) in place of those of the same ids, and delete those of gone (doc_id)."""
        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        if one.groupBy("doc_id").count().where("count > 1").limit(1).count():  # texts move only if ids repeat
            order = Window.partitionBy("doc_id").orderBy(F.desc(F.char_length("text")), F.desc("text"))
            one = one.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        sized = one.select("doc_id", F.size(R.tokens(F.col("text"))).alias("dl"))
        new = self._write(R.postings(one.select("doc_id", "text")), sized)
        ids = self._read("documents", [new[0]] if new else [], "doc_id long, dl int, segment string").select("doc_id")
        if gone is not None:
            ids = ids.union(gone.select(F.col("doc_id").cast("long")))
        held = self.segments()
        killed = self._live("documents", [s for s, *_ in held], "doc_id long, dl int, segment string").join(ids.distinct(), "doc_id", "left_semi")
        rows = [(s, n, w) for s, n, w, _ in held] + ([new] if new else [])
        self._publish(self.spark.createDataFrame(rows, "segment string, n long, words long"), self.dead().union(killed.select("segment", "doc_id", F.col("dl").cast("long"))))

    def prune(self, gone: DataFrame) -> None:
        """Delete documents (doc_id)."""
        self.upsert(self.spark.createDataFrame([], "doc_id long, text string"), gone)

    def due(self) -> list[str]:
        """Segments to be merged: FANIN of the least size class that has as many, else those of which half is dead."""
        classes: dict[int, list[str]] = {}
        for s, n, _, dead in self.segments():
            size, level = n - dead, 0
            while size >= LEAST * FANIN**level:
                level += 1
            classes.setdefault(level, []).append(s)
        full = [names for _, names in sorted(classes.items()) if len(names) >= FANIN]
        return full[0] if full else [s for s, n, _, dead in self.segments() if 2 * dead >= n]

    def merge(self) -> int:
        """Merge while segments are due; returns how many were merged."""
        merged = 0
        while names := self.due():
            postings = self._live("postings", names, _POSTINGS)
            new = self._write(postings, self._live("documents", names, "doc_id long, dl int, segment string"))
            rows = [(s, n, w) for s, n, w, _ in self.segments() if s not in names] + ([new] if new else [])
            self._publish(self.spark.createDataFrame(rows, "segment string, n long, words long"), self.dead().where(~F.col("segment").isin(names)))
            merged += len(names)
            self.recover()
        return merged

    def recover(self) -> list[str]:
        """Delete segments that the manifest does not name (left by a crash, or merged); returns them."""
        self.store.recover("manifest")
        at = self.store._at("segments")
        keep = {s for s, *_ in self.segments()}
        gone = [s.getPath() for s in self.store._fs.listStatus(at) if s.getPath().getName() not in keep] if self.store._fs.exists(at) else []
        for p in gone:
            self.store._fs.delete(p, True)
        return [p.getName() for p in gone]

    def search(self, queries: DataFrame, k: int = R.CANDIDATES) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, text). Postings of the queries' terms are read, and no text."""
        held = self.segments()
        terms = R.query_terms(queries)
        live = self._read("postings", [s for s, *_ in held], _POSTINGS).join(terms.select("term").distinct(), "term", "left_semi")
        if any(dead for *_, dead in held):
            live = live.join(self.dead(), ["segment", "doc_id"], "left_anti")
        df = live.groupBy("term").agg(F.count("*").alias("df"))
        dead_words = self.dead().agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        n = sum(n - dead for _, n, _, dead in held)
        mean = (sum(w for _, _, w, _ in held) - dead_words) / max(n, 1)
        sizes = self.spark.createDataFrame([(n, mean or 1.0)], "n long, mean double")
        return R.scored(terms.join(df, "term"), live.select("term", "doc_id", "tf", "dl"), sizes, k)


def corpus_digest(docs: DataFrame) -> str:
    """A digest of the files that a table is read from: names, lengths and times of change."""
    spark, out = docs.sparkSession, hashlib.sha256()
    for name in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.update(f"{name}\t{status.getLen()}\t{status.getModificationTime()}\n".encode())
    return out.hexdigest()


def index_of(docs: DataFrame, root: str, what: str = "") -> SegmentedIndex:
    """The index of documents (doc_id, text) under a folder: the one that was built of the same files, or a new one. what
    names the part of the files that docs is, if it is not all."""
    found = SegmentedIndex(docs.sparkSession, f"{root}/bm25-{hashlib.sha256((corpus_digest(docs) + what).encode()).hexdigest()[:32]}")
    if not found.exists():
        found.upsert(docs)
    return found
