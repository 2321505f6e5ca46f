"""A Merkle manifest of documents: leaves, one tree per source, one tree over the sources' roots, proofs.

A leaf is the SHA-256 of a row's fields. Within a source the leaves ascend by doc_id; of every FANOUT consecutive nodes
(the last run may be shorter) the parent is the SHA-256 of their digests in order, level by level, until one node is
left: the source's subroot. The subroots, by source, are the leaves of the upper tree, whose last node is the root.

Texts are read once, where they are hashed; all later tables carry digests of 32 bytes. Leaves get their row numbers from
a range partitioning, so that a source with a third of all rows is spread over many tasks; a level groups nodes by
source and index div FANOUT, FANOUT rows at most, and has a FANOUT-th of the rows of the one before. Proofs are put
together from the root down: a node's path is the siblings beside it before its parent's path, so that a full path
travels once for each FANOUT leaves. Each level is written to the shared folder. To the driver come only the number
of levels and the root.

Null fields count as '-' and so differ from empty ones; a null source is a source of its own and comes first, and null
doc_ids come first in theirs. Rows that repeat a doc_id are leaves each, ordered by their digests, and rows that repeat
another wholly have equal leaves side by side. Very long texts are hashed whole. The first character of a source's
key is ours, and other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, remove

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def digest(text: Column) -> Column:
    """SHA-256 of a string as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields: each '-' if null, else its length in bytes, a colon and its value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return digest(F.concat(*parts))


def parent(kids: Column) -> Column:
    return digest(F.array_join(F.transform(kids, hexed), ""))


def joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def beside(kids: Column, place: Column) -> Column:
    """The digests left and right of a place (from 0) among its run's."""
    return F.struct(joined(F.slice(kids, F.lit(1), place)).alias("left"), joined(F.slice(kids, place + 2, F.greatest(F.size(kids) - place - 1, F.lit(0)))).alias("right"))


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The written levels (key, i, size, kids, digest) above nodes (key, i, size, digest), size being the number of nodes
    of the key at that level; a key's last node has size 1."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels = []
    while most > 1:
        runs = nodes.where("size > 1").groupBy("key", F.expr(f"i div {fanout}").alias("i")).agg(
            F.max(F.expr(f"(size + {fanout - 1}) div {fanout}")).alias("size"), F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "digest"))).alias("kids")
        )
        runs = runs.select("key", "i", "size", F.col("kids.digest").alias("kids"))
        nodes = materialize(runs.withColumn("digest", parent(F.col("kids"))), "merkle-level")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def under(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the subroot and path that those above them have, the siblings beside the node put before it."""
    up = above.select(F.col("key").alias("_key"), F.col("i").alias("_up"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), "subroot")
    found = nodes.join(up, (F.col("key") == F.col("_key")) & (F.expr(f"i div {fanout}") == F.col("_up")))
    place = F.expr(f"cast(i % {fanout} as int)")
    return found.select(*nodes.columns, F.concat(F.array(beside(F.col("_kids"), place)), F.col("_path")).alias("path"), "subroot")


def descend(levels: list[DataFrame], nodes: DataFrame, tops: DataFrame, fanout: int) -> DataFrame:
    """Nodes with path and subroot: tops (key, path, subroot) has those of each key's last node."""
    columns, above = nodes.columns, None
    for level in [*reversed(levels), nodes]:
        last = level.where("size = 1").join(tops, "key")
        names = [*(columns if level is nodes else ["key", "i", "kids"]), "path", "subroot"]
        found = last.select(*names)
        if above is not None:
            found = found.union(under(level.where("size > 1"), above, fanout).select(*names))
        above = found
    return above


def lasts(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """(key, digest) of each key's last node."""
    found = nodes.where("size = 1").select("key", "digest")
    for level in levels:
        found = found.union(level.where("size = 1").select("key", "digest"))
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf (32 bytes) leads to by its path, as hex."""
    return F.aggregate(path, hexed(start), lambda h, s: F.sha2(F.concat(hexed(s.left), h, hexed(s.right)).cast("binary"), 256))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof (its siblings' digests from the leaf up, hex), folded_root (the root that
    the row's leaf leads to by its proof) and verified. With changed, columns put in place of FIELDS, the folded leaf is
    that of the changed row: what a verifier finds who has the manifest's proofs and other rows."""
    changed = changed or {}
    fields = docs.select(*[F.col(c) for c in FIELDS])
    rows = fields.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        leaf([F.col(c) for c in FIELDS]).alias("digest"), leaf([changed.get(c, F.col(c)) for c in FIELDS]).alias("found"),
    )
    rows = materialize(rows, "merkle-leaves")
    placed = numbered(rows, "key", ["doc_id", "digest", "found"], "merkle-order")
    leaves = materialize(placed.select("doc_id", "key", F.col("_i").alias("i"), F.col("_n").alias("size"), "digest", "found"), "merkle-numbered")
    levels = climb(leaves, fanout)
    subroots = materialize(lasts(levels, leaves).select(F.lit("").alias("all"), "key", "digest"), "merkle-subroots")
    ordered = numbered(subroots, "all", ["key"], "merkle-sources")
    upper = materialize(ordered.select(F.col("all").alias("key"), F.col("_i").alias("i"), F.col("_n").alias("size"), "digest", F.col("key").alias("source_key")), "merkle-upper")
    over = climb(upper, fanout)
    top = lasts(over, upper).first()
    root = top["digest"].hex() if top else None
    above = descend(over, upper, upper.sparkSession.createDataFrame([("",)], "key string").select("key", F.expr(_NO_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot")), fanout)
    tops = materialize(above.select(F.col("source_key").alias("key"), "path", F.col("digest").alias("subroot")), "merkle-tops")
    proven = descend(levels, leaves, tops, fanout)
    remove(rows)
    both = F.transform("path", lambda s: F.concat(hexed(s.left), hexed(s.right)))
    out = proven.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), F.array_join(both, "").alias("proof"), folded(F.col("found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest held against documents of which those whose crc32(doc_id as text) is even lost their line breaks;
    proofs as digests."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    lost = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, {"text": lost})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def sql(levels: int = 10, upper: int = 6) -> str:
    """DuckDB SQL of audited() for sources of 3**levels rows at most, and 3**upper sources. The low bit of a crc32
    comes from a table of the 256 byte steps."""
    steps = ["t0 AS (SELECT range AS b, range AS c FROM range(256))"]
    steps += [f"t{k + 1} AS (SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k})" for k in range(8)]
    steps.append("crc AS (SELECT list(c ORDER BY b) AS step FROM t8)")
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    hashed = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    crc = "list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(c >> 8, step[1 + (xor(c, x) & 255)]), 4294967295::BIGINT)"
    steps.append(f"d AS (SELECT doc_id, source, {hashed('text')} AS h, {hashed('lost')} AS found FROM (SELECT *, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS lost FROM documents, crc))")
    steps.append("a0 AS (SELECT doc_id, coalesce('=' || source, '') AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, found) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, h, found, '' AS proof, h AS leaf FROM d)")

    def tree(name: str, count: int, carried: str) -> list[str]:
        """name0 (key, i, n, h) with its levels, then the carried rows' proofs, level by level."""
        out = []
        for k in range(count):
            kids = ", ".join(f"max(h) FILTER (WHERE i % 3 = {x}) AS c{x}" for x in range(3))
            out.append(f"{name}{k + 1} AS (SELECT key, i // 3 AS i, max((n + 2) // 3) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, {kids} FROM {name}{k} WHERE n > 1 GROUP BY key, i // 3)")
        for k in range(count):
            at = f"{name}p{k}" if k else carried
            left = "CASE p.i % 3 WHEN 1 THEN c0 WHEN 2 THEN c0 || c1 ELSE '' END"
            right = "CASE p.i % 3 WHEN 0 THEN coalesce(c1, '') || coalesce(c2, '') WHEN 1 THEN coalesce(c2, '') ELSE '' END"
            out.append(
                f"{name}p{k + 1} AS (SELECT p.* REPLACE (p.i // 3 AS i, CASE WHEN k.key IS NULL THEN p.proof ELSE p.proof || {left} || {right} END AS proof, "
                f"CASE WHEN k.key IS NULL THEN p.found ELSE sha256({left} || p.found || {right}) END AS found) FROM {at} p LEFT JOIN {name}{k + 1} k ON p.key = k.key AND p.i // 3 = k.i)"
            )
        return out

    steps += tree("a", levels, "a0")
    tops = " UNION ALL ".join(f"SELECT key, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
    steps.append(f"s AS ({tops})")
    steps.append("u0 AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n, h, key AS source_key FROM s)")
    steps.append(f"c0 AS (SELECT u0.key, u0.i, p.doc_id, p.leaf, u0.h AS subroot, p.proof, p.found FROM ap{levels} p JOIN u0 ON p.key = u0.source_key)")
    steps += tree("u", upper, "c0")
    root = " UNION ALL ".join(f"SELECT h FROM u{k} WHERE n = 1" for k in range(upper + 1))
    return f"WITH {', '.join(steps)}, r AS ({root}) SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, found AS folded_root, found = r.h AS verified FROM up{upper}, r"
