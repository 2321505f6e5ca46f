"""Parts and outlines. Lines of up to three words of a document are its parts, those of four to six its chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import excerpts as X
from lectern.operators import outline as O
from lectern.sources.tables import table

from .registry import query

_PART, _CHAPTER = r"^[^\s]+(?: [^\s]+){0,2}$", r"^[^\s]+(?: [^\s]+){3,5}$"


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
o AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - len(line) - 1 AS at_, regexp_matches(line, '^[^\\s]+( [^\\s]+){0,2}$') AS is_part, regexp_matches(line, '^[^\\s]+( [^\\s]+){3,5}$') AS is_chapter FROM l),
p AS (SELECT *, last_value(CASE WHEN is_part THEN trim(line, ' .*') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM o)
SELECT doc_id, at_::BIGINT AS start, trim(line, ' .*') AS chapter, part, coalesce(part || ' — ', '') || trim(line, ' .*') AS title FROM p WHERE is_chapter""")
def t_chapters_in_parts(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note"), "text")
    found = O.chapters_in_parts(books, _CHAPTER, _PART)
    return found.select(F.col("note").alias("doc_id"), F.col("at").alias("start"), "chapter", "part", "title")


@query("""
WITH e AS (SELECT user_id, event_id, ts, max(CASE WHEN event_type = 'purchase' THEN (epoch_us(ts), event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM events)
SELECT user_id, event_id, p[2] AS last_purchase FROM e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.ts = e.ts AND x.event_id <> e.event_id)""")
def t_last_purchase(spark, sf_dir):
    """Each event's last purchase of its user, its own moment included, by microseconds in spans of a day (events that share
    their user's moment with others are left to the tests)."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    alone = e.groupBy("user_id", "at").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    found = O.last_before(e.join(alone, ["user_id", "at"]).select("user_id", "at", "event_id"), e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("value")), ["user_id"], or_at=True, span=86_400_000_000)
    return found.select("user_id", "event_id", F.col("mark").alias("last_purchase"))


@query("""
WITH c AS (SELECT source, doc_id, trim(left(text, 1500), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS opening FROM documents),
l AS (SELECT source, list({'s': len(opening)::BIGINT, 'c': [doc_id]} ORDER BY doc_id) AS l FROM c WHERE opening <> '' GROUP BY source),
f AS (SELECT source, list_reduce(list_prepend({'s': 0::BIGINT, 'c': []::BIGINT[]}, l), lambda a, x: CASE WHEN a.s + x.s <= 60000 THEN {'s': a.s + x.s, 'c': list_concat(a.c, x.c)} ELSE a END).c AS c FROM l),
t AS (SELECT source, unnest(c) AS doc_id FROM f)
SELECT t.source, count(*) AS chapters_read, string_agg('### ' || t.doc_id || chr(10) || opening, chr(10) || chr(10) ORDER BY t.doc_id) AS excerpts FROM t JOIN c ON c.doc_id = t.doc_id GROUP BY t.source""")
def t_card_excerpts(spark, sf_dir):
    """Excerpts of sources, whose documents are their chapters."""
    chapters = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body"))
    return X.excerpts(chapters).withColumnRenamed("book", "source")
