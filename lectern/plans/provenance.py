"""Provenance: benchmark texts are quotes, documents are passages; every third document is a card. A quote cites the
document with ten times its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import provenance as P
from lectern.sources.tables import table

from .registry import query
from .texts import norm_sql

_BASE = f"""q AS (SELECT item_id AS quote_id, {norm_sql('text')} AS q, item_id * 10 AS cited FROM benchmark),
p AS (SELECT doc_id AS passage_id, {norm_sql('text')} AS p, source AS book, doc_id % 3 = 0 AS card FROM documents),
h AS (SELECT quote_id, passage_id FROM q JOIN p ON contains(' ' || p || ' ', ' ' || q || ' ') WHERE q <> ''),
c AS (SELECT q.*, p.book AS cited_book, p.passage_id IS NOT NULL AS known FROM q LEFT JOIN p ON p.passage_id = q.cited),
b AS (SELECT c.*, h.passage_id, p.book, p.card FROM c LEFT JOIN h USING (quote_id) LEFT JOIN p ON p.passage_id = h.passage_id
 QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY coalesce(h.passage_id = cited, false) DESC, p.card, coalesce(p.book = cited_book, false) DESC, h.passage_id) = 1),
v AS (SELECT quote_id, CASE WHEN passage_id IS NULL THEN 'broken' WHEN passage_id = cited AND NOT card THEN 'confirmed' WHEN card THEN 'card_only' ELSE 'unattributed' END AS status,
 passage_id AS holder, CASE WHEN NOT known THEN 'no_hit' WHEN passage_id IS NULL THEN 'not_found' WHEN passage_id = cited THEN 'kept'
 WHEN len(string_split(q, ' ')) < 4 THEN 'short' WHEN book <> cited_book THEN 'cross_book' ELSE 'repinned' END AS gate FROM b)"""


def _parts(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), (F.col("item_id") * 10).alias("cited"))
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text", F.col("source").alias("book"), (F.col("doc_id") % 3 == 0).alias("card"))
    return quotes, passages, P.holders(quotes, passages)


@query(f"WITH {_BASE} SELECT quote_id, status, holder FROM v")
def p_classify(spark, sf_dir):
    return P.verdicts(*_parts(spark, sf_dir)).select("quote_id", "status", "holder")


@query(f"WITH {_BASE} SELECT s.status AS status, count(v.quote_id) AS quotes FROM (VALUES ('confirmed'), ('unattributed'), ('card_only'), ('broken')) s(status) LEFT JOIN v ON v.status = s.status GROUP BY s.status")
def p_counts(spark, sf_dir):
    found = P.verdicts(*_parts(spark, sf_dir))
    kinds = spark.createDataFrame([("confirmed",), ("unattributed",), ("card_only",), ("broken",)], "status string")
    return kinds.join(found, "status", "left").groupBy("status").agg(F.count("quote_id").alias("quotes"))


@query(f"WITH {_BASE} SELECT gate, count(*) AS items FROM v GROUP BY gate")
def p_gate_reasons(spark, sf_dir):
    return P.verdicts(*_parts(spark, sf_dir)).groupBy("gate").agg(F.count("*").alias("items"))


@query(f"WITH {_BASE} SELECT quote_id, holder, gate FROM v WHERE holder IS NOT NULL AND gate <> 'kept'")
def p_repin_priority(spark, sf_dir):
    return P.verdicts(*_parts(spark, sf_dir)).where("holder is not null and gate <> 'kept'").select("quote_id", "holder", "gate")


@query(f"WITH {_BASE} SELECT quote_id, min(passage_id) AS holder FROM h GROUP BY quote_id HAVING count(*) = 1")
def p_sole_holder(spark, sf_dir):
    return _parts(spark, sf_dir)[2].groupBy("quote_id").agg(F.min("passage_id").alias("holder"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"WITH {_BASE} SELECT h.quote_id, bool_and(p.card) AS card_only, count(*) AS holders FROM h JOIN p USING (passage_id) GROUP BY h.quote_id")
def p_card_only(spark, sf_dir):
    _, passages, held = _parts(spark, sf_dir)
    return held.join(passages.select("passage_id", "card"), "passage_id").groupBy("quote_id").agg(F.bool_and("card").alias("card_only"), F.count("*").alias("holders"))


@query(f"""SELECT conv_id, turn, NOT contains(' ' || {norm_sql('text')} || ' ', ' ' || lower(n_name) || ' ') AS unused, n_name AS title
FROM conversations JOIN nation ON n_nationkey = conv_id % 25 WHERE role = 'assistant'""")
def p_unused_titles(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    titles = table(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("k"), F.col("n_name").alias("title"))
    both = answers.join(titles, F.col("conv_id") % 25 == F.col("k"))
    return both.select("conv_id", "turn", (~X.holds(X.normalize(F.col("text")), F.lower("title"))).alias("unused"), "title")


@query(f"""SELECT source, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT source, doc_id, md5({norm_sql('text')}) AS k FROM documents) x GROUP BY source, k HAVING count(*) > 1""")
def p_dedupe_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("k"))
    return d.groupBy("source", "k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("k")
