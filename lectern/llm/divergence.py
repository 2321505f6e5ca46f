"""How sources of a language differ: the terms that mark a source, and the distance between two sources.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lowered. A language keeps the V terms that at least
LEAST_DOCS of its documents hold. With count occurrences of a term, and N of all kept terms, a source of a language (a
group) and the language itself give the term p = 1 + floor(SCALE * (count + 1) / (N + V)). The divergence of p from q
is floor((p - q)^2 / q).

* Terms of a group, the first TOP by divergence from the language among those it has and uses more than the language:
  an upper-bound search. Terms of a group are bucketed by count, so that a bucket has one p, and its lowest and
  highest q of the language bound what it holds. Buckets are evaluated best bound first, in waves of growing size; a group
  is done when the bound of its next bucket is strictly below its TOP-th value so far (a tie may still win by name).
* Pairs of groups: the sum over all kept terms, from postings. Terms that neither has are alike, and those
  that only one has depend on its count alone; so counts of terms by (group, count) give the sum but for terms that both
  have, and only those are looked up side by side.

All arithmetic is in whole numbers: SCALE * (count + 1) in decimals of 38 digits, the rest in longs, which hold as
long as a language keeps fewer than 10^9 terms. Counts are summed in each map task before anything moves, so hot
terms and hot sources cost a row per task. A posting list has a row per source, never gathered; the work on pairs
grows with the square of the sources of a language as the result does, not with documents.

Null text, language and source count as ''. Empty texts make a group, as do those without kept terms, whose pairs are
reckoned like others; a language without kept terms has value 0 for all pairs and no term rows. Repeated rows count
each. Long texts are counted piece by piece. Ties of value go by the item's bytes. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, remove
from .words import LOWER, SLICE_BYTES, slices

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: How much larger each wave of buckets is than the one before.
GROWTH = 8
#: Bytes of counted terms that a map task holds, about, before it writes them.
FLUSH_BYTES = 128 << 20

_TERM = bytes(int(LOWER[b]) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some SLICE_BYTES at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE_BYTES
        part = text[at:end].translate(_TERM)
        if end < len(text):  # up to the last gap, or on to the next if there is none
            gap = part.rfind(b" ")
            while gap < 0 and end < len(text):
                more = text[end : end + SLICE_BYTES].translate(_TERM)
                gap = more.find(b" ")
                gap, part, end = (len(part) + gap if gap >= 0 else -1), part + more, end + len(more)
            part = part[: gap + 1] if gap >= 0 else part
        yield part.split()
        at += len(part)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text), summed over many rows."""
    found: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0

    def flush():
        for (lang, source), terms in found.items():
            names = list(terms)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                n, docs = zip(*(terms[t] for t in part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

    for batch in batches:
        for part, texts in slices(batch, text=2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                terms = found.setdefault((lang, source), {})
                own: Counter[bytes] = Counter()
                for some in pieces(text):
                    own.update(some)
                for t, k in own.items():
                    have = terms.get(t)
                    if have is None:
                        terms[t] = [k, 1]
                        held += sys.getsizeof(t) + 200
                    else:
                        have[0] += k
                        have[1] += 1
                if held > FLUSH_BYTES:
                    yield from flush()
                    found.clear()
                    held = 0
    yield from flush()


def share(n: Column | str, whole: Column | str) -> Column:
    """p of a count in a group where N + V is whole."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * (cast({n} as decimal(19,0)) + 1)) div cast({whole} as decimal(20,0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: postings (lang, source, term, n, total: of the language) of kept terms; groups (lang, source, whole:
    N + V, v, has: terms that it has, all_whole: the language's N + V).

    Counts move once, to the partition of their language and term, where they are summed, and terms of few documents
    dropped."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"total": F.sum("n").over(term), "all_docs": F.sum("docs").over(term), "least": F.min("source").over(term)}).where(F.col("all_docs") >= LEAST_DOCS)
    postings = materialize(kept.select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).alias("once")), "postings")
    languages = postings.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count_if("once").alias("v"))
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("has"))
    every = texts.select("lang", "source").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = every.join(held, ["lang", "source"], "left").join(languages, "lang", "left").select(
        "lang", "source", (zero("own_n") + zero("v")).alias("whole"), zero("v").alias("v"), zero("has").alias("has"), (zero("all_n") + zero("v")).alias("all_whole")
    )
    return postings.drop("once"), materialize(groups, "groups")


def marking_terms(postings: DataFrame, groups: DataFrame, top: int = TOP, growth: int = GROWTH) -> DataFrame:
    """(lang, source, item, value, rank): the first top terms of each group."""
    of = ["lang", "source"]
    best = Window.partitionBy(*of)
    buckets = postings.groupBy(*of, "n").agg(F.count("*").alias("m"), F.min("total").alias("total")).join(groups.select(*of, "whole", "all_whole"), of)
    # p is the bucket's; the lowest q gives the most that a term of it can have
    buckets = buckets.withColumn("p", share("n", "whole")).withColumn("q", share("total", "all_whole")).where("p > q").withColumn("bound", divergence("p", "q"))
    ahead = F.coalesce(F.sum("m").over(best.orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = materialize(buckets.withColumn("ahead", ahead).select(*of, "n", "p", "all_whole", "bound", "ahead"), "buckets")
    last = buckets.agg(F.max("ahead")).first()[0]
    found, kth, lo, hi = None, None, 0, top
    while last is not None and lo <= last:
        wave = buckets.where(f"ahead >= {lo} and ahead < {hi}")
        if kth is not None:  # what is strictly below cannot enter
            wave = wave.join(kth, of, "left").where("least_value is null or bound >= least_value").drop("least_value")
        terms = postings.join(wave, [*of, "n"]).withColumn("q", share("total", "all_whole")).where("p > q")
        terms = terms.select(*of, F.col("term").alias("item"), divergence("p", "q").alias("value"))
        both = terms if found is None else terms.union(found.drop("rank"))
        ranked = both.withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
        older, found = found, materialize(ranked, "top-terms")
        if older is not None:
            remove(older)
        kth = found.where(F.col("rank") == top).select(*of, F.col("value").alias("least_value"))
        left = buckets.where(f"ahead >= {hi}").join(kth, of, "left").where("least_value is null or bound >= least_value")
        lo, hi = hi, hi * growth
        if not left.limit(1).count():
            break
    remove(buckets)
    if found is None:
        return groups.limit(0).select(*of, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank"))
    return found


def source_pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each other source of a group's language, by falling divergence from it."""
    of = ["lang", "source"]
    # p of a term that a group has not
    sized = groups.where("v > 0").withColumn("none", share("0", "whole"))
    each = lambda df, x: df.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "lang"])
    pairs = each(groups.select(*of, "v"), "a").join(each(groups.select(*of), "b"), "lang").where("source_a <> source_b")
    names = ["lang", "source_a", "source_b"]
    ends = each(sized.select(*of, "none", "v", "has"), "a").join(each(sized.select(*of, "none", "has"), "b"), "lang").where("source_a <> source_b")
    ends = materialize(ends, "source-pairs")
    neither = ends.withColumn("value", (F.col("v_a") - F.col("has_a") - F.col("has_b")) * divergence("none_a", "none_b")).select(*names, "value")
    # terms by (group, count), as if the other had none of them
    counts = postings.groupBy(*of, "n").agg(F.count("*").alias("m")).join(groups.select(*of, "whole"), of).select(*of, "m", share("n", "whole").alias("p"))
    counts = materialize(counts, "source-counts")
    of_a = ends.join(each(counts, "a"), ["lang", "source_a"]).select(*names, (F.col("m_a") * divergence("p_a", "none_b")).alias("value"))
    of_b = ends.join(each(counts, "b"), ["lang", "source_b"]).select(*names, (F.col("m_b") * divergence("none_a", "p_b")).alias("value"))
    # terms that both have: what they add in place of both of those, less what `neither` lost twice
    held = postings.join(sized.select(*of, "whole", "none"), of).select("lang", "term", "source", "none", share("n", "whole").alias("p"))
    side = lambda x: held.select("lang", "term", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "none", "p")])
    f = lambda a, b: divergence(f"{a}_a", f"{b}_b")
    shared = side("a").join(side("b"), ["lang", "term"]).where("source_a <> source_b")
    shared = shared.select(*names, (f("p", "p") - f("p", "none") - f("none", "p") + f("none", "none")).alias("value"))
    total = neither.union(of_a).union(of_b).union(shared.groupBy(*names).agg(F.sum("value").alias("value"))).groupBy(*names).agg(F.sum("value").alias("value"))
    # languages without kept terms have pairs of value 0
    found = pairs.select(*names).join(total, names, "left").select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) with part 'pair' and 'term'."""
    postings, groups = term_counts(docs)
    names = ["lang", "source", "part", "item", "value", "rank"]
    parts = [source_pairs(postings, groups).withColumn("part", F.lit("pair")), marking_terms(postings, groups).withColumn("part", F.lit("term"))]
    return parts[0].select(*names).union(parts[1].select(*names))


#: DuckDB SQL of audit().
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p, 1 + ({SCALE}::HUGEINT * (total + 1)) // (sum(total) OVER w + count(*) OVER w) AS q FROM cell WINDOW w AS (PARTITION BY lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
