"""Plain engine coverage over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.sources.tables import table

from .registry import both, query

both("x_rollup_lineitem", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping(l_linestatus) AS g
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")

both("x_pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

both("x_semi_anti", """
SELECT 'with' AS kind, count(*) AS customers FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)
UNION ALL SELECT 'without', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""")

both("x_setops", """
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) b
UNION ALL SELECT 'except', count(*) FROM (SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation) c
UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) d""")

both("x_range_window", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""")

#: The last heading before each text, as of its place: one ordered pass, no range join.
both("x_asof_section", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events""", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events""")

both("x_first_last_per_key", """
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id""")

both("x_top_customers", """
SELECT n_name, c_custkey, spend FROM (SELECT n.n_name, c.c_custkey, round(sum(o.o_totalprice), 2) AS spend,
 row_number() OVER (PARTITION BY n.n_name ORDER BY sum(o.o_totalprice) DESC, c.c_custkey) AS place
 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name, c.c_custkey) x WHERE place <= 3""")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) x GROUP BY start""")
def x_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("""
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, sid""")
def x_session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


@query("SELECT event_id, json_valid(props) AS valid, len(json_keys(props))::BIGINT AS keys FROM events")
def x_props_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$").isNotNull().alias("valid"), F.size(F.json_object_keys("props")).cast("long").alias("keys"))
