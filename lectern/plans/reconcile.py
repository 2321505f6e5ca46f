"""Reconciliation: orders stand in for the ledger's books, line items for indexed rows, documents for texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import ledger as L
from lectern.operators import lengths
from lectern.sources import sinks
from lectern.sources.tables import table

from .registry import both, query

both("q_rows_by_book", "SELECT coalesce(l_orderkey, -1) AS book, count(*) AS row_count FROM lineitem GROUP BY coalesce(l_orderkey, -1)")

def _ledger(spark, sf_dir):
    """Orders as a ledger of books: half of them indexed, with a row count for each; one in forty has a twin of its key."""
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 40 == 0, F.concat(F.lit("k"), F.col("o_orderkey") + 1)).otherwise(F.concat(F.lit("k"), "o_orderkey"))
    return o.select(F.concat(F.lit("b"), "o_orderkey").alias("book_id"), key.alias("key"), F.when(F.col("o_orderstatus") == "F", "indexed").otherwise("requested").alias("status"), (F.col("o_custkey") % 7 + 1).alias("rows"))


@query("""
WITH led AS (SELECT 'b' || o_orderkey AS book_id, 'k' || CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS name, o_orderstatus AS status, o_custkey % 7 + 1 AS expected FROM orders),
idx AS (SELECT 'k' || l_orderkey AS book, CASE WHEN l_suppkey % 11 = 0 THEN '' WHEN l_suppkey % 11 = 1 THEN 'x' || l_orderkey ELSE 'b' || l_orderkey END AS book_id FROM lineitem),
n AS (SELECT book_id, count(*) AS found FROM idx GROUP BY book_id), crd AS (SELECT 'k' || (p_partkey * 9) AS name, count(*) AS in_cards FROM part GROUP BY 1),
txt AS (SELECT book AS name, count(*) AS in_text FROM idx GROUP BY book)
SELECT CASE WHEN status <> 'F' THEN 'never_indexed' WHEN n.found IS NULL THEN 'indexed_but_absent' ELSE 'row_count_drift' END AS kind, name, coalesce(n.found, 0) AS found, expected
 FROM led LEFT JOIN n USING (book_id) WHERE status <> 'F' OR n.found IS NULL OR n.found <> expected
UNION ALL SELECT 'duplicate_key', name, count(DISTINCT book_id), NULL FROM led GROUP BY name HAVING count(DISTINCT book_id) > 1
UNION ALL SELECT CASE WHEN in_text IS NULL THEN 'card_without_book' ELSE 'not_in_ledger' END, coalesce(t.name, c.name), coalesce(in_text, in_cards), NULL
 FROM txt t FULL OUTER JOIN crd c ON t.name = c.name WHERE coalesce(t.name, c.name) NOT IN (SELECT name FROM led)
UNION ALL SELECT 'orphan_rows', CASE WHEN book_id = '' THEN 'no book_id' ELSE 'unknown book_id' END, CAST(sum(found) AS BIGINT), NULL FROM n WHERE book_id NOT IN (SELECT book_id FROM led) GROUP BY 2""")
def q_doctor_drift(spark, sf_dir):
    """All seven kinds: line items are indexed rows, some without an id or with an unknown one; parts are cards."""
    s = F.col("l_suppkey") % 11
    owner = F.when(s == 0, "").when(s == 1, F.concat(F.lit("x"), "l_orderkey")).otherwise(F.concat(F.lit("b"), "l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), "l_orderkey").alias("book"), owner.alias("book_id"))
    cards = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey") * 9).alias("book"))
    return L.check(_ledger(spark, sf_dir), rows, cards)

both("q_duplicate_keys", "SELECT o_custkey AS book_key, count(*) AS copies, min(o_orderkey) AS first_id FROM orders GROUP BY o_custkey HAVING count(*) > 1")

@query("""
WITH c AS (SELECT lang, length(text) AS n_chars, count(*) AS k FROM documents GROUP BY lang, length(text)),
t AS (SELECT lang, n_chars, sum(k) OVER (PARTITION BY lang ORDER BY n_chars) AS upto, sum(k) OVER (PARTITION BY lang) AS n FROM c)
SELECT lang, CAST(max(n) AS BIGINT) AS n, min(CASE WHEN upto > least(n - 1, floor(0.5 * n)) THEN n_chars END) AS median,
 min(CASE WHEN upto > least(n - 1, floor(0.95 * n)) THEN n_chars END) AS p95, max(n_chars) AS longest FROM t GROUP BY lang""")
def q_length_distribution(spark, sf_dir):
    return lengths.distribution(table(spark, sf_dir, "documents").select("lang", F.char_length("text").alias("length")), "lang")

@query("SELECT source, count(*) AS over_ceiling, max(length(text)) AS longest FROM documents WHERE length(text) > 2640 GROUP BY source")
def q_length_drift(spark, sf_dir):
    return lengths.over_ceiling(table(spark, sf_dir, "documents").select("source", F.char_length("text").alias("length")), "source")

both("q_foreign_keys", """
SELECT DISTINCT l_orderkey AS book FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')""")

both("q_uncompared", """
WITH a AS (SELECT DISTINCT p_partkey AS k FROM part), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45),
s AS (SELECT 'only_prepared' AS side, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'only_indexed', k FROM b WHERE k NOT IN (SELECT k FROM a))
SELECT side, count(*) AS keys, min(k) AS first_key, max(k) AS last_key FROM s GROUP BY side""")

@query("""
WITH f AS (SELECT doc_id, CAST(ceil(length(text) / 2400.0) AS BIGINT) AS least_chunks, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents)
SELECT doc_id, least_chunks, CAST(line_count AS BIGINT) AS line_count FROM f WHERE line_count < least_chunks""")
def q_stamp_floor(spark, sf_dir):
    """Documents whose lines are fewer than the chunks that their characters need: no chunker made rows of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.chunk_floor(F.char_length("text")).alias("least_chunks"), F.size(F.split("text", "\n")).cast("long").alias("line_count"))
    return d.where("line_count < least_chunks")

@query("""
WITH n AS (SELECT l_orderkey AS k, count(*) AS n, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY l_orderkey)
SELECT 'b' || o_orderkey AS book_id, CASE WHEN o_orderstatus = 'F' THEN 'settled' WHEN n.k IS NULL THEN 'nothing_written' WHEN lo <> hi THEN 'mixed_revisions'
 WHEN lo <> 'N' THEN 'stale' WHEN n.n >= o_custkey % 7 + 1 THEN 'complete' ELSE 'partial' END AS outcome FROM orders LEFT JOIN n ON n.k = o_orderkey""")
def q_recover_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("b"), "l_orderkey").alias("book_id"), F.col("l_returnflag").alias("book_rev"))
    return L.recovery(_ledger(spark, sf_dir).withColumn("sha256", F.lit("N")), rows)

@query("""
WITH i AS (SELECT c_custkey AS ord, 'k' || c_custkey % 900 AS key, 'r' || c_nationkey * 7 AS ref, 's' || c_custkey % 50 AS sha FROM customer),
led AS (SELECT 'b' || s_suppkey AS id, 'k' || s_suppkey AS key, 'r' || s_suppkey AS ref, 's' || s_suppkey AS sha FROM supplier),
k AS (SELECT i.*, l.id AS by_key, r.id AS by_ref, t.key AS same_text, t.id AS same_id, row_number() OVER (PARTITION BY i.key ORDER BY ord) = 1 AS head
 FROM i LEFT JOIN led l ON l.key = i.key LEFT JOIN led r ON r.ref = i.ref LEFT JOIN led t ON t.sha = i.sha),
c AS (SELECT *, coalesce(by_key, CASE WHEN head THEN by_ref END) AS claims FROM k),
a AS (SELECT *, by_key IS NULL AND head AND by_ref IS NOT NULL AND row_number() OVER (PARTITION BY claims ORDER BY ord) = 1 AS adopts FROM c),
m AS (SELECT *, CASE WHEN by_key IS NOT NULL OR NOT head THEN 'key' WHEN adopts THEN 'source' ELSE 'new' END AS matched_by,
 CASE WHEN by_key IS NOT NULL THEN by_key WHEN adopts THEN by_ref ELSE md5(key || chr(31) || ref) END AS own FROM a),
o AS (SELECT m.ord, h.own AS book_id, m.matched_by, m.same_text, m.same_id FROM m JOIN m h ON h.key = m.key AND h.head)
SELECT ord, book_id, matched_by, CASE WHEN matched_by = 'new' AND NOT EXISTS (SELECT 1 FROM o e WHERE e.book_id = o.same_id AND e.ord < o.ord) THEN same_text END AS twin FROM o""")
def q_ledger_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    incoming = c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("k"), F.col("c_custkey") % 900).alias("key"), F.concat(F.lit("r"), F.col("c_nationkey") * 7).alias("source_ref"), F.concat(F.lit("s"), F.col("c_custkey") % 50).alias("sha256"))
    s = table(spark, sf_dir, "supplier")
    held = s.select(*[F.concat(F.lit(x), "s_suppkey").alias(name) for x, name in (("b", "book_id"), ("k", "key"), ("r", "source_ref"), ("s", "sha256"))])
    return L.resolve(L.with_fields(held), incoming)

@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'),
led AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS tag FROM orders WHERE o_orderstatus <> 'P')
SELECT k || '.txt' AS path, CASE WHEN led.k IS NOT NULL THEN 'b' || k END AS book_id, CASE WHEN led.k IS NULL THEN 'new' ELSE 'known' END AS state FROM f LEFT JOIN led USING (k)
UNION ALL SELECT led.k || '.txt', 'b' || led.k, 'vanished' FROM led WHERE tag = 'a' AND k NOT IN (SELECT k FROM f)""")
def q_ledger_diff(spark, sf_dir):
    """Files are known by key (even ones) or by their reference; only rows of folder `a` can vanish."""
    k = F.col("l_orderkey").cast("string")
    f = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1996-01-01 00:00:00'").select("l_orderkey").distinct()
    tag = F.when(F.col("o_orderstatus") == "F", "a").otherwise("b")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("b"), "o_orderkey").alias("book_id"), F.concat(F.lit("k"), "o_orderkey").alias("key"), F.concat(F.lit("local:"), tag, F.lit(":"), "o_orderkey", F.lit(".txt")).alias("source_ref"))
    refs = o.select("source_ref", F.regexp_extract("source_ref", r"(\d+)\.txt", 1).alias("n"))
    files = f.withColumn("n", k).join(refs, "n", "left")
    key = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("k"), "n")).otherwise(F.concat(F.lit("renamed"), "n"))
    return L.diff(L.with_fields(o), files.select(F.concat("n", F.lit(".txt")).alias("path"), key.alias("key"), F.coalesce("source_ref", F.concat(F.lit("local:a:"), "n", F.lit(".txt"))).alias("source_ref")), "a")


@query("""
WITH new AS (SELECT s_suppkey AS book_id, 'n' || (s_suppkey * 3) AS note, 'new' AS origin FROM supplier),
old AS (SELECT c_custkey AS book_id, 'n' || c_custkey AS note, 'old' AS origin FROM customer)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE book_id NOT IN (SELECT book_id FROM new) AND note NOT IN (SELECT note FROM new)""")
def q_upsert_book(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"), F.concat(F.lit("n"), F.col("s_suppkey") * 3).alias("note"), F.lit("new").alias("origin"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.concat(F.lit("n"), "c_custkey").alias("note"), F.lit("old").alias("origin"))
    return sinks.upserted(old, new, ["book_id", "note"])


@query("""SELECT 'n' || l_suppkey AS note, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'id' || l_suppkey ELSE '' END AS book_id, '' AS book_rev FROM lineitem""")
def q_backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), "l_suppkey").alias("note"), "l_orderkey", "l_linenumber")
    ids = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("n"), "s_suppkey").alias("note"), F.concat(F.lit("id"), "s_suppkey").alias("book_id"))
    return sinks.backfilled(rows, ids)


@query("""
WITH want AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS s FROM documents WHERE lang <> 'es'),
have AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN source = 'src3' THEN text || '.' ELSE text END) AS s FROM documents WHERE lang <> 'fr')
SELECT coalesce(w.path, h.path) AS path, CASE WHEN h.s IS NULL THEN 'missing' WHEN w.s IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
FROM want w FULL OUTER JOIN have h ON w.path = h.path WHERE h.s IS NULL OR w.s IS NULL OR h.s <> w.s""")
def q_manifest_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    want = d.where("lang <> 'es'").select("path", F.sha2("text", 256).alias("sha256"))
    have = d.where("lang <> 'fr'").select("path", F.sha2(F.when(F.col("source") == "src3", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return sinks.verify_manifest(want, have)


@query("SELECT sha256(string_agg(sha256(url) || '  ' || page_id, chr(10) ORDER BY CAST(page_id AS VARCHAR))) AS digest, count(*) AS files FROM pages")
def q_directory_digest(spark, sf_dir):
    return sinks.directory_digest(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("url", 256).alias("sha256")))


both("q_version_policy", """
WITH stamps AS (SELECT s_suppkey AS tbl, s_nationkey % 3 AS model, s_suppkey % 4 AS version FROM supplier)
SELECT tbl, CASE WHEN model <> 0 THEN 'refuse' WHEN version > 2 THEN 'refuse_newer' WHEN version < 2 THEN 'warn' ELSE 'ok' END AS verdict, greatest(version, 2) AS recorded FROM stamps""")

both("q_orphan_rows", """
SELECT CASE WHEN l.l_suppkey IS NULL THEN 'empty' ELSE 'unknown' END AS kind, count(*) AS row_count FROM lineitem l
LEFT ANTI JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 2000 GROUP BY 1""", """
SELECT CASE WHEN l.l_suppkey IS NULL THEN 'empty' ELSE 'unknown' END AS kind, count(*) AS row_count FROM lineitem l
ANTI JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 2000 GROUP BY 1""")
