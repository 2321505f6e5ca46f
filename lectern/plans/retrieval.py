"""Hybrid retrieval: vectors are embeddings (documents by vec_id), queries every vector whose id is divisible by 20; text queries are
whole benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.operators.segments import index_of
from lectern.sources.tables import table, work_path

from .registry import query


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def _vector_queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("doc_id % 20 = 0").select((F.col("doc_id") / 20).cast("long").alias("query_id"), F.col("v").alias("q"))


def _bm25(spark, sf_dir, docs, what=""):
    """The first query of a corpus builds its index; others read it."""
    return index_of(docs.select("doc_id", "text"), work_path(spark, "bm25").rpartition("/")[0], what).search(_text_queries(spark, sf_dir))


def _text_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_L2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_COS = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_TOK = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _knn_sql(metric: str, order: str, where: str = "true") -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank FROM (
 SELECT q.vec_id // 20 AS query_id, v.vec_id AS doc_id, round({metric}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND {where}) s) r WHERE rank <= 20"""


def _bm25_sql(docs: str = "documents") -> str:
    return f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
d AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id, dl),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / st.mean))), 6) AS score
 FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY q.query_id, p.doc_id),
bm AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) r WHERE rank <= 20)"""


def _rrf_sql(knn: str, docs: str, k: int) -> str:
    return f"""WITH {_bm25_sql(docs)}, kn AS ({knn})
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rv ASC NULLS LAST, rf) AS rank FROM (
 SELECT coalesce(kn.query_id, bm.query_id) AS query_id, coalesce(kn.doc_id, bm.doc_id) AS doc_id, kn.rank AS rv, bm.rank AS rf,
  round(coalesce(1.0::DOUBLE / (60 + kn.rank), 0) + coalesce(1.0::DOUBLE / (60 + bm.rank), 0), 9) AS score
 FROM kn FULL OUTER JOIN bm ON kn.query_id = bm.query_id AND kn.doc_id = bm.doc_id) x) y WHERE rank <= {k}"""


_KNN = _knn_sql(_L2, "ASC")
_EN = "(SELECT * FROM documents WHERE lang = 'en') en"


@query(_KNN)
def h_knn_top20(spark, sf_dir):
    return R.knn(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir))


@query(_knn_sql(_COS, "DESC"))
def h_cosine_topk(spark, sf_dir):
    return R.knn(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), metric=R.cosine, descending=True)


@query(f"WITH {_bm25_sql()} SELECT * FROM bm")
def h_bm25_top20(spark, sf_dir):
    return _bm25(spark, sf_dir, table(spark, sf_dir, "documents"))


@query(_rrf_sql(_KNN, "documents", 8))
def h_hybrid_rrf(spark, sf_dir):
    return R.rrf(h_knn_top20(spark, sf_dir), _bm25(spark, sf_dir, table(spark, sf_dir, "documents")), 8).select("query_id", "doc_id", "score", "rank")


@query(_rrf_sql(_knn_sql(_L2, "ASC", "v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"), _EN, 4))
def h_rrf_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    near = R.knn(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi"))
    return R.rrf(near, _bm25(spark, sf_dir, docs, "en"), 4).select("query_id", "doc_id", "score", "rank")


_BUDGET = """WITH c AS (SELECT k.*, CASE WHEN d.lang = 'en' THEN 'cards' ELSE 'transcripts' END AS corpus FROM ({knn}) k JOIN documents d USING (doc_id))
SELECT query_id, corpus, doc_id, place FROM (SELECT query_id, corpus, doc_id, row_number() OVER (PARTITION BY query_id, corpus ORDER BY rank) AS place FROM c) r
WHERE place <= CASE WHEN corpus = 'cards' THEN {cards} ELSE 4 END"""


def _budget(spark, sf_dir, cards):
    lang = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "cards").otherwise("transcripts").alias("corpus"))
    hits = h_knn_top20(spark, sf_dir).join(lang, "doc_id")
    placed = R.top(hits, ["query_id", "corpus"], [F.asc("rank")], 4, "place")
    return placed.where(F.col("place") <= F.when(F.col("corpus") == "cards", cards).otherwise(4)).select("query_id", "corpus", "doc_id", "place")


@query(_BUDGET.format(knn=_KNN, cards=2))
def h_two_corpora_budget(spark, sf_dir):
    return _budget(spark, sf_dir, 2)


@query(_BUDGET.format(knn=_KNN, cards=4))
def h_identify_slots(spark, sf_dir):
    return _budget(spark, sf_dir, 4)
