"""Names, searches and catalogue requests through the library's operators: parts stand in for books, conversations for
runs of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import naming
from lectern.sources.tables import table

from .registry import query

#: What a catalogue can be asked.
CATALOG_OPS = ("count", "list", "has", "by_author")


@query("""
WITH b AS (SELECT p_partkey, p_name, p_name || ' — ' || p_brand AS book FROM part),
a AS (SELECT p_partkey AS ask_id, CASE WHEN p_partkey % 40 = 0 THEN book ELSE p_name END AS name, p_partkey % 40 = 0 AS whole FROM b WHERE p_partkey % 20 = 0)
SELECT a.ask_id, b.p_partkey, b.book FROM a JOIN b ON CASE WHEN a.whole THEN b.book ELSE b.p_name END = a.name""")
def c_rows_for_book(spark, sf_dir):
    books = table(spark, sf_dir, "part").select("p_partkey", "p_name", X.book_key(F.col("p_name"), F.col("p_brand")).alias("book"))
    asked = books.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("ask_id"), F.expr("CASE WHEN p_partkey % 40 = 0 THEN book ELSE p_name END").alias("name"))
    return naming.rows_for_names(books.select("p_partkey", "book"), asked).select("ask_id", "p_partkey", "book")


@query(r"""
SELECT conv_id AS run, key, '' AS book, min(turn) AS step FROM (
 SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'), '^[ \pP]+|[ \pP]+$', '', 'g')) AS key FROM conversations WHERE role = 'user') x
WHERE key <> '' GROUP BY conv_id, key""")
def l_new_searches(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return naming.new_searches(asked.select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.col("text").alias("query"), F.lit(None).cast("string").alias("book")))


@query("""
SELECT conv_id, turn, op, CASE WHEN op = 'has' THEN trim(text) ELSE '' END AS title FROM (
 SELECT conv_id, turn, text, ['count', 'drop', 'has', 'by_author'][turn % 4 + 1] AS op FROM conversations) x
WHERE op = 'count' OR (op = 'has' AND trim(text) <> '')""")
def l_catalog_requests(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").withColumn("op", F.expr("element_at(array('count', 'drop', 'has', 'by_author'), cast(turn % 4 + 1 AS int))"))
    reply = F.to_json(F.struct(F.struct("op", F.when(F.col("op") == "has", F.col("text")).alias("title")).alias("catalog")))
    asked = said.select("conv_id", "turn", naming.catalogue_request(reply, CATALOG_OPS).alias("r"))
    return asked.where("r is not null").select("conv_id", "turn", "r.op", "r.title")
