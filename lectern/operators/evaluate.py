"""Scoring of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that end a refusal, and the words of prose that may follow one.
REFUSALS = (
    "not included", "not in this", "not in the library", "not in my library", "cannot answer", "can't answer", "cannot provide", "don't know", "do not have",
    "not available", "no evidence", "not part of", "does not contain", "do not contain", "is not contained", "are not contained", "does not include", "do not include",
    "does not cover", "do not cover", "is not covered", "are not covered", "не містить", "не містять", "не знаю", "немає", "нема ", "не входить", "не можу відповісти", "доказів",
)
TAIL_WORDS = 60


def is_refusal(folded: Column) -> Column:
    """Whether a folded answer refuses: its earliest marker (the longest there) has at most TAIL_WORDS words behind it,
    bracketed citations not counted."""
    at = F.array(*[F.struct(F.instr(folded, m).alias("p"), F.lit(-len(m)).alias("l")) for m in REFUSALS])
    first = F.array_min(F.filter(at, lambda x: x["p"] > 0))
    tail = F.regexp_replace(F.substring(folded, first["p"] - first["l"], F.char_length(folded)), r"\[[^\[\]]*\]", " ")
    words = F.size(F.filter(F.split(tail, r"\s+"), lambda w: w != ""))
    return F.coalesce(words <= TAIL_WORDS, F.lit(False))
