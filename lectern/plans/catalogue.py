"""Catalogue queries: books are documents under the key 'Doc <id> — <source>'; German rows stand in for canaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.tables import table

from .registry import both, query

KEY = "concat('Doc ', doc_id, ' — ', source)"

both("cat_list_books", f"""
WITH cards AS (SELECT {KEY} AS book, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
texts AS (SELECT {KEY} AS book, source FROM documents)
SELECT book, max(c) = 1 AS has_card, max(t) = 1 AS has_text FROM (
  SELECT book, 1 AS c, 0 AS t FROM cards UNION ALL SELECT book, 0, 1 FROM texts) u
WHERE book IS NOT NULL AND book <> '' GROUP BY book""")

both("cat_count", f"SELECT count(DISTINCT {KEY}) AS books, count(*) AS texts FROM documents")

both("cat_by_author", f"SELECT source AS author, count(DISTINCT {KEY}) AS books, min(doc_id) AS first_id FROM documents GROUP BY source")

both("cat_has_title", f"""
WITH wanted AS (SELECT item_id, concat('Doc ', item_id * 7) AS title FROM benchmark),
held AS (SELECT DISTINCT concat('Doc ', doc_id) AS title, {KEY} AS book FROM documents)
SELECT w.item_id, w.title, count(h.book) AS copies, count(h.book) > 0 AS held FROM wanted w LEFT JOIN held h ON h.title = w.title GROUP BY w.item_id, w.title""")

both("cat_flags_bool_or", """
SELECT d.source AS source, bool_or(l.doc_id IS NOT NULL) AS any_label, bool_and(l.doc_id IS NOT NULL) AS all_labelled,
 bool_or(coalesce(l.toxic, 0) = 1) AS any_toxic, count(*) AS docs
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""")

both("cat_exclude_canary", """
SELECT source AS book, count(*) AS row_count, sum(CASE WHEN lang = 'de' THEN 0 ELSE 1 END) AS kept_rows
FROM documents GROUP BY source HAVING sum(CASE WHEN lang = 'de' THEN 0 ELSE 1 END) > 0""".replace("sum(CASE WHEN lang = 'de' THEN 0 ELSE 1 END) AS", "CAST(sum(CASE WHEN lang = 'de' THEN 0 ELSE 1 END) AS BIGINT) AS"))


@query("""
SELECT concat('Doc ', doc_id, ' — ', source) AS book, concat('Doc ', doc_id) AS title, source AS author FROM documents""")
def f_split_key(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.concat(F.lit("Doc "), "doc_id", F.lit(" — "), "source").alias("book"))
    return books.select("book", X.title_of(F.col("book")).alias("title"), X.author_of(F.col("book")).alias("author"))


both("r_resolve_exact", """
WITH asked AS (SELECT c_custkey AS ask_id, lower(trim(c_name)) AS wanted FROM customer),
names AS (SELECT s_suppkey AS held_id, lower(trim(replace(s_name, 'Supplier', 'Customer'))) AS name FROM supplier)
SELECT a.ask_id, count(n.held_id) AS matches, min(n.held_id) AS held_id FROM asked a LEFT JOIN names n ON n.name = a.wanted GROUP BY a.ask_id""")

#: Each word run of a part's name, looked up in all names: containment as an equi-join on words, checked on the whole.
both("r_resolve_contained", """
WITH asked AS (SELECT DISTINCT p_type AS wanted FROM part),
names AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part),
words AS (SELECT DISTINCT name, brand, w FROM (SELECT name, brand, explode(split(name, ' ')) AS w FROM names) x)
SELECT a.wanted, count(DISTINCT w.name) AS matches FROM asked a LEFT JOIN words w
 ON w.w = a.wanted AND length(a.wanted) >= 4 AND concat(' ', w.name, ' ') LIKE concat('% ', a.wanted, ' %') GROUP BY a.wanted""", """
WITH asked AS (SELECT DISTINCT p_type AS wanted FROM part),
names AS (SELECT DISTINCT p_brand AS brand, p_name AS name FROM part),
words AS (SELECT DISTINCT name, brand, w FROM (SELECT name, brand, unnest(string_split(name, ' ')) AS w FROM names) x)
SELECT a.wanted, count(DISTINCT w.name) AS matches FROM asked a LEFT JOIN words w
 ON w.w = a.wanted AND length(a.wanted) >= 4 AND concat(' ', w.name, ' ') LIKE concat('% ', a.wanted, ' %') GROUP BY a.wanted""")


@query()
def r_resolve_fuzzy(spark, sf_dir):
    """Misspelt nation names against the catalogue of nations."""
    from lectern.operators.resolve import resolve_names

    held = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    asked = held.select(F.concat(F.substring("name", 1, 3), F.substring("name", 5, 100)).alias("asked"))
    return resolve_names(asked, held)


@query()
def r_suggestions(spark, sf_dir):
    """Regions asked about under half their names: no match, but the closest names."""
    from lectern.operators.resolve import resolve_names

    held = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return resolve_names(held.select(F.concat(F.reverse(F.substring("name", 1, 2)), F.substring("name", 3, 100), F.lit("xyz")).alias("asked")), held)


@query()
def r_clarify_choice(spark, sf_dir):
    """Replies in conversations read as a choice between three candidates."""
    from lectern.operators.resolve import resolve_choice

    replies = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return replies.select("conv_id", "turn", resolve_choice(F.col("text"), ["The Long Road", "The Short Road", "Night Harbour"]).alias("choice"))
