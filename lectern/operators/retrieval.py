"""Retrieval for a batch of queries: exact vector search, BM25, reciprocal rank fusion."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Candidates of each list, and the constants of fusion and BM25.
CANDIDATES, RRF_K, K1, B = 20, 60, 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group: a rank filter that Spark pushes below the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


#: Queries and vectors that are compared with each other in one task, and vectors of those at a time.
BLOCK, PART, ROWS = 4096, 8192, 1024
#: Scores are rounded to six digits: a pair may lie so far behind the k-th and still be among the first k.
MARGIN = 2e-6


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    if len(set(pc.list_value_length(vectors).to_pylist())) > 1:
        raise ValueError("vectors are of different lengths")
    flat = vectors.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(vectors), -1)


def _in_order(a: np.ndarray, b: np.ndarray, term) -> np.ndarray:
    """Sums of term(a, b) over the columns from the first to the last, as dot() and squared_l2() add them."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += term(a[:, j], b[:, j])
    return out


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * y


def nearest(q: np.ndarray, v: np.ndarray, k: int, by_cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of at least the k best of v for each of q. Matrix products tell which pairs can be
    among them; only those get the metric itself. Vectors without length have no cosine, and come last."""
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    margin = MARGIN if by_cosine else MARGIN + 1e-12 * (qq.max(initial=0.0) + vv.max(initial=0.0))
    reach, found = np.full((len(q), k), np.inf), []
    for at in range(0, len(v), ROWS):
        product, part = q @ v[at : at + ROWS].T, vv[at : at + ROWS]
        with np.errstate(invalid="ignore", divide="ignore"):
            score = -product / np.sqrt(qq[:, None] * part) if by_cosine else qq[:, None] - 2.0 * product + part
        score[np.isnan(score)] = np.inf
        reach = np.partition(np.concatenate([reach, score], axis=1), k - 1, axis=1)[:, :k]
        rows, columns = np.nonzero(score <= reach.max(axis=1)[:, None] + margin)
        found.append((rows, columns + at, score[rows, columns]))
    rows, columns, score = (np.concatenate(x) for x in zip(*found))
    still = score <= reach.max(axis=1)[rows] + margin
    rows, columns = rows[still], columns[still]
    exact = np.empty(len(rows))
    for at in range(0, len(rows), PART):
        a, b = q[rows[at : at + PART]], v[columns[at : at + PART]]
        if by_cosine:
            with np.errstate(invalid="ignore", divide="ignore"):
                exact[at : at + PART] = _in_order(a, b, _times) / (np.sqrt(_in_order(a, a, _times)) * np.sqrt(_in_order(b, b, _times)))
        else:
            exact[at : at + PART] = _in_order(a, b, lambda x, y: (x - y) * (x - y))
    return rows, columns, exact


def knn(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, metric=squared_l2, descending: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): all vectors (doc_id, v) against a stated set of queries (query_id, q).

    metric: squared_l2, or cosine (descending). Queries are dealt into blocks of about BLOCK and vectors into parts of
    about PART; each part meets each block in one task, which keeps its k best (and what ties with them). Null vectors are
    not compared."""
    if (metric, descending) not in ((squared_l2, False), (cosine, True)):
        raise ValueError("knn ranks by squared_l2 ascending or by cosine descending")
    by_cosine = metric is cosine
    queries, vectors = queries.where("q is not null"), vectors.where("v is not null")
    blocks, parts = -(-queries.count() // BLOCK) or 1, -(-vectors.count() // PART) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.select("query_id", "q", dealt("query_id", blocks).alias("block"), every(parts).alias("part"))
    held = vectors.select("doc_id", "v", every(blocks).alias("block"), dealt("doc_id", parts).alias("part"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            rows, columns, score = (np.empty(0, t) for t in ("int64", "int64", "float64"))
        else:
            rows, columns, score = nearest(_matrix(a["q"]), _matrix(b["v"]), k, by_cosine)
        return pa.table({"query_id": a["query_id"].take(pa.array(rows)), "doc_id": b["doc_id"].take(pa.array(columns)), "score": pa.array(score)})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    pairs = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(compare, schema)
    pairs = pairs.select("query_id", "doc_id", F.round(F.nanvl("score", F.lit(None).cast("double")), 6).alias("score"))
    best = F.desc("score") if descending else F.asc("score")
    return top(pairs, ["query_id"], [best, F.asc("doc_id")], k)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of documents (doc_id, text)."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    each = words.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return each.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


#: Partitions over which an index deals one term's postings, so that a frequent term is no single task's.
SPREAD = 8


#: Terms of queries (query_id, term) that are sent to all postings at most.
TERMS = 200_000


class Index(NamedTuple):
    """A BM25 index that was written: postings (term, doc_id, tf, dl), terms (term, df) and sizes (n, mean), one row."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame


def build_index(docs: DataFrame, path: str) -> Index:
    """Write the index of documents (doc_id, text) to a folder that all machines share. The texts are read and tokenised
    once for the postings, and their sizes come from the same pass; files are sorted by term, so that a reader of some
    terms skips the rest."""
    dealt = postings(docs).repartition("term", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("term", "doc_id")
    dealt.write.parquet(f"{path}/postings")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{path}/postings")
    written.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    total = docs.agg(F.count("*").alias("n"))
    words = written.agg(F.sum("tf").alias("words"))
    total.join(F.broadcast(words)).select("n", (F.coalesce("words", F.lit(0)) / F.greatest("n", F.lit(1))).alias("mean")).write.parquet(f"{path}/sizes")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in Index._fields))


def bm25(queries: DataFrame, index: Index, k: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, text). Only the postings of the queries' terms are joined;
    no document is read."""
    terms = query_terms(queries)
    return scored(terms.join(index.terms, "term"), index.postings, index.sizes, k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def scored(terms: DataFrame, postings: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The first k documents by BM25 of terms (query_id, term, df), from postings (term, doc_id, tf, dl) and sizes (n, mean).

    Up to TERMS terms of queries are sent to the postings, which are dealt by document first: each posting then moves
    once, however many queries have its term, and sums do not move at all. More terms meet postings by term."""
    weighed = terms.join(F.broadcast(sizes))
    weighed = weighed.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    if terms.limit(TERMS + 1).count() <= TERMS:
        weighed, postings = F.broadcast(weighed), postings.repartition("doc_id")
    sums = weighed.join(postings, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(w), 6).alias("score"))
    return top(sums, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def rrf(vector: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Fuse two ranked lists (query_id, doc_id, rank): the sum of 1 / (60 + rank); ties keep the vector list's order,
    then the text list's."""
    a = vector.select("query_id", "doc_id", F.col("rank").alias("rv"))
    b = text.select("query_id", "doc_id", F.col("rank").alias("rf"))
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part("rv") + part("rf"), 9))
    return top(fused, ["query_id"], [F.desc("score"), F.asc_nulls_last("rv"), F.asc("rf")], k)
