"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells (source, language, topic); a cell's weight starts as its tokens and is raked in turn to
the target share of each source, language and topic, until the factors are steady (TOLERANCE). Targets that no
weights of the cells can meet have no steady factors: raking then ends after MOST_TURNS, with a warning of what is left. A document of cell c is then
wanted factor(c) = weight(c) / tokens(c) times; scaled so that no document is wanted more than once (and the sample
has `share` of the corpus's tokens at most), that is its probability, and it is sampled when a uniform number that
its id and text fix falls below. So every kept token's expected weight matches the targets where cells allow it.

The cells are a table (one row per combination), written once; each turn reads its few margins, whose number is that
of the targets given, and no document moves. Values that a target does not name form one class, OTHER, with the rest of
the weight. Null values are the class OTHER too. Documents without tokens are in no sample (probability 0).
"""

from __future__ import annotations

import warnings
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when no factor changes by more than this in a turn, or after so many turns.
TOLERANCE, MOST_TURNS = 1e-9, 60
#: Turns that the SQL writes out.
TURNS = 30
#: There is no topic column; a text's form stands in: its characters per line, up to these limits.
FORMS = ((150, "list"), (400, "notes"))
LONGEST_FORM = "essay"


def tokens(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def topic(text: Column) -> Column:
    """The form of the whole text, by its mean line length (null and empty texts: the shortest)."""
    length = F.coalesce(F.char_length(text), F.lit(0))
    lines = length - F.coalesce(F.char_length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    out = F.lit(LONGEST_FORM)
    for limit, name in reversed(FORMS):
        out = F.when(length <= limit * lines, name).otherwise(out)
    return out


def _class(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*targets), value).otherwise(OTHER) if targets else F.lit(OTHER)


def _full(targets: dict[str, float]) -> dict[str, float]:
    rest = max(0.0, 1 - sum(targets.values()))
    return targets | ({OTHER: targets.get(OTHER, 0.0) + rest} if rest > 1e-12 or OTHER in targets else {})


def fit(cells: DataFrame, targets: dict[str, dict[str, float]], turns: int = MOST_TURNS) -> tuple[dict[str, dict[str, float]], float]:
    """Factors by dimension and class, and the largest change of a factor in the last turn (0 without tokens). cells:
    source, lang, topic, tokens; only margins come to the driver."""
    full = {d: _full(targets[d]) for d in DIMENSIONS}
    factors = {d: dict.fromkeys(full[d], 1.0) for d in DIMENSIONS}
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    most = 0.0
    if not total:
        return factors, most
    for _ in range(turns):
        most = 0.0
        for d in DIMENSIONS:
            now = {r[d]: r["w"] for r in cells.groupBy(d).agg(F.sum(F.col("tokens") * _factor(factors)).alias("w")).collect()}
            held = sum(share for k, share in full[d].items() if now.get(k))  # classes without documents give up their share
            for k, share in full[d].items():
                if now.get(k):
                    step = share / held * total / now[k] if held else 1.0
                    most = max(most, abs(step - 1))
                    factors[d][k] *= step
        if most < TOLERANCE:
            break
    else:
        warnings.warn(f"targets are not met: factors still change by {most:.3g} a turn", stacklevel=3)
    return factors, most


def _factor(factors: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for d in DIMENSIONS:
        pairs = [x for k, v in factors[d].items() for x in (F.lit(k), F.lit(float(v)))]
        if pairs:
            out = out * F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(1.0))
    return out


def uniform(id_col: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) fixed by a row's id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", topic_col: Column | None = None) -> DataFrame:
    """The rows with their classes, n_tokens, weight (times wanted, before scaling), probability and sampled."""
    text = F.col(text_col)
    rows = docs.withColumns({
        "_source": _class(F.col("source"), targets["source"]), "_lang": _class(F.col("lang"), targets["lang"]),
        "_topic": _class(topic_col if topic_col is not None else topic(text), targets["topic"]), "_tokens": tokens(text),
    })
    # every row's class and count, once; texts are read again, not moved
    cells = rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    factors, _ = fit(cells, targets)
    names = {d: f"_{d}" for d in DIMENSIONS}
    scale = cells.where("tokens > 0").agg(F.max(_factor(factors)).alias("m"), F.sum(F.col("tokens") * _factor(factors)).alias("w"), F.sum("tokens").alias("n")).first()
    top = 1.0
    if scale["m"]:
        top = min(1 / scale["m"], share * scale["n"] / scale["w"])
    factor = F.lit(1.0)
    for d in DIMENSIONS:
        pairs = [x for k, v in factors[d].items() for x in (F.lit(k), F.lit(float(v)))]
        if pairs:
            factor = factor * F.coalesce(F.element_at(F.create_map(*pairs), F.col(names[d])), F.lit(1.0))
    out = rows.withColumn("_weight", factor).withColumn("_p", F.when(F.col("_tokens") > 0, F.least(F.lit(1.0), F.col("_weight") * F.lit(top))).otherwise(0.0))
    return out.withColumn("_sampled", uniform(F.col(id_col), text) < F.col("_p"))


def corpus_targets() -> dict[str, dict[str, float]]:
    """The query's targets: even over the 20 sources, and fixed shares of languages and topics."""
    return {
        "source": {f"src{i}": 0.05 for i in range(20)},
        "lang": {"en": 0.58, "fr": 0.15, "de": 0.15, "es": 0.12},
        "topic": {"list": 0.1, "notes": 0.7, "essay": 0.2},
    }


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = 1.0) -> DataFrame:
    """Per row: doc_id, source, lang and topic class, n_tokens, weight and probability (6 digits), sampled."""
    found = mix(docs, targets or corpus_targets(), share)
    return found.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_p", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )


def sql(targets: dict[str, dict[str, float]] | None = None, turns: int = TURNS, share: float = 1.0) -> str:
    """The same as DuckDB SQL over `documents`, with the raking written out turn by turn."""
    targets = targets or corpus_targets()
    full = {d: _full(targets[d]) for d in DIMENSIONS}
    listed = lambda d: ", ".join(f"'{k}'" for k in targets[d])
    limits = " ".join(f"WHEN l <= {limit} * k THEN '{name}'" for limit, name in FORMS)
    parts = [
        f"""t AS MATERIALIZED (SELECT doc_id, text, CASE WHEN source IN ({listed('source')}) THEN source ELSE '{OTHER}' END AS source,
 CASE WHEN lang IN ({listed('lang')}) THEN lang ELSE '{OTHER}' END AS lang, length(coalesce(text, '')) AS l, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS k,
 len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')) AS n FROM documents)""",
        f"""d AS MATERIALIZED (SELECT doc_id, text, source, lang, n, CASE {limits} ELSE '{LONGEST_FORM}' END AS topic FROM t)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens, 1.0::DOUBLE AS f FROM d GROUP BY 1, 2, 3)",
        *[f"g_{d}(k, s) AS MATERIALIZED (VALUES {', '.join(f"('{k}', {v!r}::DOUBLE)" for k, v in full[d].items())})" for d in DIMENSIONS],
    ]
    at = 0
    for _, d in product(range(turns), DIMENSIONS):
        parts.append(f"""m{at + 1} AS MATERIALIZED (SELECT {d} AS k, sum(tokens * f) AS w FROM c{at} GROUP BY 1),
h{at + 1} AS MATERIALIZED (SELECT g.k, g.s / (SELECT sum(s) FROM g_{d} WHERE k IN (SELECT k FROM m{at + 1} WHERE w > 0)) * (SELECT sum(tokens) FROM c0) / m.w AS step FROM g_{d} g JOIN m{at + 1} m ON m.k = g.k WHERE m.w > 0),
c{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.f * coalesce(h.step, 1) AS f FROM c{at} c LEFT JOIN h{at + 1} h ON h.k = c.{d})""")
        at += 1
    return "WITH " + ",\n".join(parts) + f""",
z AS (SELECT least(1 / max(f), {share!r} * sum(tokens) / sum(tokens * f)) AS top FROM c{at} WHERE tokens > 0)
SELECT d.doc_id, d.source, d.lang, d.topic, d.n AS n_tokens, round(c.f, 6) AS weight,
 CASE WHEN d.n > 0 THEN round(least(1.0, c.f * z.top), 6) ELSE 0.0 END AS probability,
 ('0x' || substr(md5('mix:' || d.doc_id::VARCHAR || ':' || md5(coalesce(d.text, ''))), 1, 12))::BIGINT / {float(16**12)!r} < CASE WHEN d.n > 0 THEN least(1.0, c.f * z.top) ELSE 0.0 END AS sampled
FROM d JOIN c{at} c USING (source, lang, topic), z"""
