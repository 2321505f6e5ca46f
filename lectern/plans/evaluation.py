"""Evaluation operators: retrieval metrics over the vector search (a hit is relevant when its label is the query's),
and scores over conversations, events and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import evaluate as E
from lectern.sources.tables import table

from .registry import both, query
from .retrieval import _KNN, h_knn_top20

_HITS = f"""hits AS (SELECT k.query_id, k.rank, q.label = v.label AS good FROM ({_KNN}) k JOIN embeddings q ON q.vec_id = k.query_id * 20 JOIN embeddings v ON v.vec_id = k.doc_id WHERE k.doc_id <> k.query_id * 20)"""


def _hits(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    k = h_knn_top20(spark, sf_dir).where("doc_id <> query_id * 20")
    mine = v.select((F.col("vec_id") / 20).alias("query_id"), F.col("label").alias("want"), "vec_id").where("vec_id % 20 = 0").withColumn("query_id", F.col("query_id").cast("long")).drop("vec_id")
    return k.join(mine, "query_id").join(v.withColumnRenamed("vec_id", "doc_id"), "doc_id").select("query_id", "rank", (F.col("label") == F.col("want")).alias("good"))


@query(f"WITH {_HITS} SELECT query_id, bool_or(good AND rank <= 5) AS at_4, bool_or(good AND rank <= 9) AS at_8 FROM hits GROUP BY query_id")
def e_presence_at_k(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("query_id").agg(*[F.bool_or(F.col("good") & (F.col("rank") <= k + 1)).alias(f"at_{k}") for k in (4, 8)])


@query(f"WITH {_HITS} SELECT round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, count(*) AS queries FROM (SELECT query_id, min(CASE WHEN good THEN rank - 1 END) AS best FROM hits GROUP BY query_id) x")
def e_mrr_best_of_two(spark, sf_dir):
    best = _hits(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank") - 1)).alias("best"))
    return best.agg(F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("queries"))


@query(f"""WITH {_HITS}, b AS (SELECT query_id, min(CASE WHEN good THEN rank - 1 END) AS best FROM hits GROUP BY query_id)
SELECT k, CAST(sum(CASE WHEN best <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM b, (VALUES (2), (4), (8)) t(k) GROUP BY k""")
def e_hit_at_k(spark, sf_dir):
    best = _hits(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank") - 1)).alias("best"))
    each = best.select("best", F.explode(F.array(*map(F.lit, (2, 4, 8)))).alias("k"))
    return each.groupBy("k").agg(F.count_if(F.col("best") <= F.col("k")).alias("hits"))


@query(f"WITH {_HITS} SELECT query_id, round(sum(CASE WHEN good THEN 1 ELSE 0 END) / count(*), 6) AS coverage FROM hits GROUP BY query_id")
def e_coverage(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("query_id").agg(F.round(F.count_if("good") / F.count("*"), 6).alias("coverage"))


@query("""SELECT u.conv_id, u.turn, len(list_filter(string_split(lower(u.text), ' '), lambda f: contains(lower(a.text), f)))::BIGINT AS facts_found, len(string_split(u.text, ' '))::BIGINT AS facts_expected
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def e_facts_found(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("answer"))
    facts = asked.join(said, ["conv_id", "turn"]).withColumnRenamed("w", "facts")
    return facts.select("conv_id", "turn", F.size(F.filter("facts", lambda f: F.col("answer").contains(f))).cast("long").alias("facts_found"), F.size("facts").cast("long").alias("facts_expected"))


@query("""SELECT conv_id, turn, conv_id % 3 <> 0 AND (conv_id % 3 = 1 OR len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 60) AS refusal FROM conversations""")
def e_is_refusal(spark, sf_dir):
    """A refusal put before or after each turn's text: before it, the text is the tail and must be short."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.lower("text"))
    marker = "the library does not contain this."
    answer = F.when(F.col("conv_id") % 3 == 0, F.col("t")).when(F.col("conv_id") % 3 == 1, F.concat("t", F.lit(" " + marker))).otherwise(F.concat(F.lit("does not contain "), F.col("t")))
    return c.select("conv_id", "turn", E.is_refusal(answer).alias("refusal"))


@query("""WITH want AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS b FROM lineitem GROUP BY l_orderkey),
got AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT CASE WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT w.k AS item, w.b = g.b AS exact FROM want w JOIN got g ON g.k = w.k""")
def e_score_catalog(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    listed = F.when(F.col("l_quantity") > 45, "X").otherwise(F.col("l_returnflag"))
    sets = items.groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("l_returnflag").alias("want"), F.collect_set(listed).alias("got"))
    return sets.select("item", (F.sort_array("want") == F.sort_array("got")).alias("exact"))


both("e_spread", "SELECT event_type, round(min(value), 2) AS low, round(median(value), 2) AS middle, round(max(value), 2) AS high FROM events GROUP BY event_type")

both("e_group_totals", """
SELECT event_type, user_id % 5 AS attempt, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (user_id % 5), ())""")

both("e_expected_denominators", """
SELECT o.o_orderpriority AS grp, count(DISTINCT o.o_orderkey) AS items, count(l.l_orderkey) AS completed FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' GROUP BY o.o_orderpriority""")

both("e_scope_verdict", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ERROR' WHEN text LIKE '%the%' AND turn % 2 = 0 THEN 'CONTAINED' WHEN text LIKE '%the%' THEN 'ANSWERED' ELSE 'REFUSED' END AS verdict FROM conversations""")

both("e_golden_violations", """
SELECT item_id, concat_ws(', ', CASE WHEN length(text) < 150 THEN 'too short' END, CASE WHEN text LIKE '%,%' THEN 'holds a comma' END, CASE WHEN item_id % 7 = 0 THEN 'unknown key' END) AS violations
FROM benchmark WHERE length(text) < 150 OR text LIKE '%,%' OR item_id % 7 = 0""")

both("e_plan_score", """
SELECT e.user_id, CAST(sum(CASE WHEN e.event_type = 'view' AND e.value > 100 THEN 1 ELSE 0 END) AS BIGINT) AS routed, count(*) AS plans,
 round(sum(CASE WHEN e.event_type IN ('view', 'click') THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS share FROM events e GROUP BY e.user_id""")
