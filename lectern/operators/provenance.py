"""Which passages hold a quote: whole-word contiguous containment of normalised texts, and the verdicts built on it."""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X

GRAM = 4
JOINER = "\n[...]\n"


def _head(words: Column, k: int) -> Column:
    return F.xxhash64(*[F.xxhash64(F.get(words, F.lit(i))) for i in range(k)])


def holders(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """(quote_id, passage_id) where the passage (passage_id, text) holds the quote (quote_id, quote).

    Quotes meet passages by the hash of their first four words (shorter ones by their first word), so this is an
    equi-join and not all pairs; the whole quote is checked then. A passage joined from chunks is contiguous only
    between its joiners."""
    q = quotes.select("quote_id", X.normalize(F.col("quote")).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    q = q.withColumn("k", F.when(F.size("w") >= GRAM, GRAM).otherwise(1)).withColumn("h", F.when(F.col("k") == GRAM, _head(F.col("w"), GRAM)).otherwise(_head(F.col("w"), 1)))
    segments = passages.select("passage_id", F.posexplode(F.split("text", F.lit(r"\n\[\.\.\.\]\n"))).alias("segment", "s"))
    p = segments.select("passage_id", "segment", F.transform(F.split(X.normalize(F.col("s")), " "), lambda w: F.xxhash64(w)).alias("ws"))
    grams = lambda k: F.when(F.size("ws") >= k, F.transform(F.sequence(F.lit(0), F.size("ws") - k), lambda i: F.xxhash64(*[F.get("ws", i + j) for j in range(k)])))
    none = F.array().cast("array<bigint>")
    tagged = lambda k: F.transform(F.array_distinct(F.coalesce(grams(k), none)), lambda h: F.struct(F.lit(k).alias("k"), h.alias("h")))
    marks = F.concat(tagged(GRAM), tagged(1))
    # hashes alone meet; texts are joined and normalised for the candidates only
    met = p.select("passage_id", "segment", F.explode(marks).alias("m")).select("passage_id", "segment", "m.k", "m.h").join(q, ["k", "h"])
    cand = met.select("passage_id", "segment", "quote_id", "q").join(segments, ["passage_id", "segment"])
    return cand.where(X.holds(X.normalize(F.col("s")), F.col("q"))).select("quote_id", "passage_id").distinct()


def verdicts(quotes: DataFrame, passages: DataFrame, held: DataFrame) -> DataFrame:
    """Per quote (quote_id, quote, cited): status, the passage that holds it, and how it got there.

    confirmed: the cited passage holds it; unattributed: another passage of book text does; card_only: only cards do;
    broken: none. The best other holder is of the same book first, book text before cards, then the least id."""
    facts = passages.select("passage_id", "book", "card")
    cited = quotes.join(facts.select(F.col("passage_id").alias("cited"), F.col("book").alias("cited_book"), F.lit(True).alias("known")), "cited", "left")
    with_holder = cited.join(held.join(facts, "passage_id"), "quote_id", "left")
    order = [F.desc(F.col("passage_id").eqNullSafe(F.col("cited"))), F.asc(F.col("card")), F.desc(F.col("book").eqNullSafe(F.col("cited_book"))), F.asc("passage_id")]
    best = with_holder.withColumn("n", F.row_number().over(Window.partitionBy("quote_id").orderBy(*order))).where("n = 1").drop("n")
    status = F.when(F.col("passage_id").isNull(), "broken").when(F.col("passage_id").eqNullSafe(F.col("cited")) & ~F.col("card"), "confirmed").when(F.col("card"), "card_only").otherwise("unattributed")
    tokens = X.token_count(X.normalize(F.col("quote")))
    gate = (
        F.when(F.col("known").isNull(), "no_hit").when(F.col("passage_id").isNull(), "not_found")
        .when(F.col("passage_id") == F.col("cited"), "kept").when(tokens < GRAM, "short")
        .when(F.col("book") != F.col("cited_book"), "cross_book").otherwise("repinned")
    )
    return best.select("quote_id", status.alias("status"), F.col("passage_id").alias("holder"), gate.alias("gate"))


_WORD = re.compile(r"\w+")


def best_window(passage: str, query: str, width: int) -> tuple[int, int] | None:
    """The span of up to width characters that holds the most different words of the query, then the more even and
    frequent mix of them, then the shorter, then the earlier; None if it holds none."""
    wanted = set(_WORD.findall(query.lower()))
    hits = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(passage.lower()) if m.group() in wanted]
    best, found, lo, held = None, None, 0, Counter()
    for hi, (_, end, word) in enumerate(hits):
        held[word] += 1
        while end - hits[lo][0] > width and lo < hi:
            held[hits[lo][2]] -= 1
            held += Counter()
            lo += 1
        key = (len(held), sorted(held.values()), hits[lo][0] - end, -hits[lo][0])
        if end - hits[lo][0] <= width and (best is None or key > best):
            best, found = key, (hits[lo][0], end)
    return found


def quote_span(passage: str, quote: str) -> tuple[int, int] | None:
    """Offsets in a raw passage of a quote's words in a row, not across a joiner."""
    wanted = _WORD.findall(quote.lower())
    barrier = [m.start() for m in re.finditer(re.escape(JOINER), passage)]
    words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(passage.lower())]
    for i in range(len(words) - len(wanted) + 1 if wanted else 0):
        run = words[i : i + len(wanted)]
        if [w for w, _, _ in run] == wanted and bisect.bisect(barrier, run[0][1]) == bisect.bisect(barrier, run[-1][1]):
            return run[0][1], run[-1][2]
    return None


def spans(passage: Column, query: Column, width: int | None = None) -> Column:
    """Array (start, end): of the best window of that width, or without one of the query as a quote; null if none."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([(best_window(a or "", b or "", width) if width else quote_span(a or "", b or "")) for a, b in zip(p, q)])

    return find(passage, query)
