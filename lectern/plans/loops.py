"""Folds over ordered runs: events stand in for a run's steps (user = run), conversations for threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import streaks
from lectern.sources.tables import table

from .registry import both, query

both("l_gate_deltas", """
SELECT event_id, user_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 4) AS delta,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events""")

both("l_new_passages_per_step", """
WITH f AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events)
SELECT user_id, count(*) AS steps, CAST(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM f GROUP BY user_id""")

both("l_search_repeats", "SELECT user_id, count(*) - count(DISTINCT event_type) AS repeats FROM events GROUP BY user_id")

both("l_query_dedupe", """
SELECT conv_id, turn, k FROM (SELECT conv_id, turn, k, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS n FROM (
 SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')) AS k FROM conversations WHERE role = 'user') x) y WHERE n = 1""", """
SELECT conv_id, turn, k FROM (SELECT conv_id, turn, k, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS n FROM (
 SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM conversations WHERE role = 'user') x) y WHERE n = 1""")

both("l_history_last3", """
SELECT conv_id, turn, left(text, 500) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'assistant') x WHERE n <= 3""")

both("l_uncovered_books", """
WITH hits AS (SELECT l_orderkey AS run, l_suppkey AS book, min(l_linenumber) AS first_seen, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey),
ev AS (SELECT DISTINCT l_orderkey AS run, l_suppkey AS book FROM lineitem WHERE l_returnflag = 'R')
SELECT h.run, h.book, h.n, row_number() OVER (PARTITION BY h.run ORDER BY h.n DESC, h.first_seen, h.book) AS place
FROM hits h LEFT JOIN ev e ON e.run = h.run AND e.book = h.book WHERE e.run IS NULL""")

both("l_withhold_cards", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AND count(*) OVER (PARTITION BY user_id) > 1 AS withheld FROM events""")

both("l_stop_reason", """
WITH r AS (SELECT user_id, count(*) AS steps, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors, max(value) AS peak FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN peak > 480 THEN 'timeout' WHEN errors >= 30 THEN 'dry' WHEN steps >= 100 THEN 'step_limit' ELSE 'answered' END AS reason FROM r""")

both("l_clarify_candidates", """
WITH e AS (SELECT l_orderkey AS run, l_suppkey AS book, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS part, l_linenumber AS n FROM lineitem),
b AS (SELECT run, book, min(part * 1000 + n) AS ord FROM e GROUP BY run, book)
SELECT run, book, row_number() OVER (PARTITION BY run ORDER BY ord, book) AS place FROM b""")

both("l_usage_by_role", """
SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) * 3.0 / 1000000, 4) AS cost FROM conversations GROUP BY role""")

_FOLD = """
WITH RECURSIVE s AS (SELECT user_id, event_type IN ('purchase', 'signup') AS fresh, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
f AS (SELECT user_id, 0::BIGINT AS step, 0::BIGINT AS dry, 0::BIGINT AS dropped, 0::BIGINT AS peak FROM (SELECT DISTINCT user_id FROM events) u
 UNION ALL
 SELECT s.user_id, s.step,
  CASE WHEN s.fresh THEN 0 WHEN s.gone THEN CASE WHEN f.dropped + 1 >= 2 THEN f.dry + 1 ELSE f.dry END ELSE f.dry + 1 END,
  CASE WHEN s.fresh THEN 0 WHEN s.gone THEN f.dropped + 1 ELSE 0 END,
  greatest(f.peak, CASE WHEN s.fresh THEN 0 WHEN s.gone THEN CASE WHEN f.dropped + 1 >= 2 THEN f.dry + 1 ELSE f.dry END ELSE f.dry + 1 END)
 FROM f JOIN s ON s.user_id = f.user_id AND s.step = f.step + 1)
SELECT user_id, step AS steps, dry, dropped, peak FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1"""


@query(_FOLD)
def l_streaks(spark, sf_dir):
    return streaks.streaks(table(spark, sf_dir, "events"))


@query("""
WITH h AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS hit_id, l_orderkey // 32 AS run, l_linenumber AS step, l_quantity < 40 AS card, 'B' || l_suppkey % 6 AS title, 'B' || l_suppkey % 6 || ' — S' AS book, l_linestatus AS text FROM lineitem),
r AS (SELECT DISTINCT o_orderkey // 32 AS run, 'B' || (o_orderkey // 32) % 6 || ' — S' AS chosen, 2 AS asked_step FROM orders WHERE (o_orderkey // 32) % 2 = 0),
f AS (SELECT l_orderkey // 32 AS run, l_linenumber AS step, 'B' || l_partkey % 6 AS title, row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY l_linenumber, l_orderkey * 1000000 + l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08),
s AS (SELECT h.*, h.card AND EXISTS (SELECT 1 FROM h e WHERE e.run = h.run AND e.card AND e.book = h.book AND e.text = h.text AND e.step < h.step
  AND NOT coalesce(h.book = r.chosen AND h.step > r.asked_step AND e.step <= r.asked_step, false)) AS seen FROM h LEFT JOIN r ON r.run = h.run),
o AS (SELECT s.*, seen AND NOT EXISTS (SELECT 1 FROM f WHERE f.run = s.run AND f.step < s.step AND f.title = s.title AND f.n > (SELECT count(*) FROM f g WHERE g.run = s.run AND g.step < s.step) - 6) AS out_ FROM s)
SELECT hit_id, out_ AND NOT (min(out_::INT) OVER (PARTITION BY run, step) = 1) AS withheld FROM o""")
def l_withheld_cards(spark, sf_dir):
    """Runs are blocks of 32 order keys, their steps line numbers; lines of less than 40 pieces are cards, returned ones with a
    discount over 8 % are refused quotes, and every other run chose a book after its second step."""
    from lectern.operators import withhold as W

    line = table(spark, sf_dir, "lineitem").withColumn("run", F.expr("l_orderkey div 32"))
    name = lambda c: F.concat(F.lit("B"), F.col(c) % 6)
    hits = line.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("hit_id"), "run", F.col("l_linenumber").alias("step"), (F.col("l_quantity") < 40).alias("card"), F.concat(name("l_suppkey"), F.lit(" — S")).alias("book"), F.lit("").alias("section"), F.col("l_linestatus").alias("text"))
    runs = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 32").alias("run")).distinct().where("run % 2 = 0").select("run", F.concat(F.lit("B"), F.col("run") % 6, F.lit(" — S")).alias("chosen"), F.lit(2).alias("asked_step"))
    refused = line.where("l_returnflag = 'R' and l_discount > 0.08").select("run", F.col("l_linenumber").alias("step"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("ord"), name("l_partkey").alias("book"))
    return W.withheld(hits, runs, refused).select("hit_id", "withheld")
