"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts are words (letters and digits, lower case); shingles are WIDTH words, hashed to 64 bits. Windows of SIZE shingles
begin every SIZE / 2, so any passage of up to SIZE / 2 shingles lies whole within one. A window's sketch is a
one-permutation MinHash: the hash's top BITS bits name one of 2^BITS bins, and the least hash of each bin that is not
empty is a band of its own. A shingle that window and template share is a common band unless another shingle of the
window falls below it in its bin: probability SIZE / 2^(BITS + 1) at most, 1 in 8,000 with these settings, for
each shared shingle; so a template of which at least PERCENT % of the shingles are there is missed with that
probability for one shingle and practically never for more. Windows that share a band with a template are then
compared exactly: the share of the template's distinct shingles among the window's is its containment.

DataFrame functions only, no shuffle but the last small aggregation; the broadcast is the template table, whose size
the caller gives and check_templates bounds. Null, empty and shorter texts than WIDTH words match nothing. Extra
columns are ignored, rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, SIZE, BITS, PERCENT = 5, 256, 20, 75
#: Bound of the broadcast template table, in words over all templates.
MOST_WORDS = 200_000

#: Notices of well-known public licenses.
TEMPLATES = {
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def check_templates(templates: dict[str, str]) -> None:
    words = [len(plain_words(t)) for t in templates.values()]
    if min(words, default=WIDTH) < WIDTH or max(words, default=0) > SIZE // 2 or sum(words) > MOST_WORDS:
        raise ValueError(f"templates need {WIDTH} to {SIZE // 2} words each (cut longer ones up), {MOST_WORDS} in all")


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingles(hashes: str) -> Column:
    """Hashes of WIDTH consecutive word hashes (a column's name)."""
    places = F.when(F.size(hashes) >= WIDTH, F.sequence(F.lit(0), F.size(hashes) - WIDTH)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))


def _shingled(df: DataFrame, text: Column) -> DataFrame:
    hashed = df.withColumn("_hashes", F.transform(words(text), lambda w: F.xxhash64(w)))
    return hashed.withColumn("_grams", shingles("_hashes")).drop("_hashes")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once; inlined, a lambda would work it out at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bands(grams: Column) -> Column:
    """The least hash of each bin that is not empty."""
    place = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    return _let(F.sort_array(grams), lambda o: F.filter(o, lambda h, i: (i == 0) | (place(h) != place(F.get(o, i - 1)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that it holds: doc_id, template, first_word (of the first window that holds it),
    n_windows, containment (largest, 4 digits)."""
    templates = templates or TEMPLATES
    check_templates(templates)
    spark = docs.sparkSession
    given = _shingled(spark.createDataFrame(list(templates.items()), "template string, words string"), F.col("words"))
    given = given.select("template", F.array_distinct("_grams").alias("wanted"))
    listed = given.withColumn("bands", bands(F.col("wanted"))).select("template", "wanted", F.explode("bands").alias("band"))
    all_bands = listed.agg(F.sort_array(F.collect_set("band")).alias("b")).first()["b"]  # bounded by check_templates
    any_band = F.array(*[F.lit(b) for b in all_bands])
    grams = _shingled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).where("_text is not null"), F.col("_text")).select("doc_id", "_grams")
    starts = F.when(F.size("_grams") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_grams") - SIZE // 2 - 1), F.lit(SIZE // 2)))
    window = lambda s: _let(F.slice("_grams", s + 1, SIZE), lambda g: F.struct(s.alias("start"), g.alias("grams"), F.array_intersect(bands(g), any_band).alias("hits")))
    found = grams.select("doc_id", F.explode(F.filter(F.transform(starts, window), lambda w: F.size(w["hits"]) > 0)).alias("w"))
    candidates = found.select("doc_id", "w.start", "w.grams", F.explode("w.hits").alias("band")).join(F.broadcast(listed), "band")
    share = F.size(F.array_intersect("wanted", "grams")) / F.size("wanted")
    held = candidates.select("doc_id", "template", "start", share.alias("share"), (100 * F.size(F.array_intersect("wanted", "grams")) >= percent * F.size("wanted")).alias("ok")).where("ok")
    held = held.groupBy("doc_id", "template", "start").agg(F.max("share").alias("share"))
    return held.groupBy("doc_id", "template").agg(F.min("start").cast("long").alias("first_word"), F.count("*").alias("n_windows"), F.round(F.max("share"), 4).alias("containment"))


def sql(templates: dict[str, str] | None = None, percent: int = PERCENT) -> str:
    """The exact result as DuckDB SQL over `documents`: every window that holds enough of a template."""
    templates = templates or TEMPLATES
    rows = {(name, " ".join(w[i : i + WIDTH])) for name, text in templates.items() for w in [plain_words(text)] for i in range(len(w) - WIDTH + 1)}
    values = ", ".join(f"('{n}', '{s}')" for n, s in sorted(rows))
    half = SIZE // 2
    return f"""
WITH tpl(template, gram) AS (VALUES {values}),
sizes AS (SELECT template, count(*) AS n FROM tpl GROUP BY template),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) - {WIDTH - 1} AS n, unnest(range(len(w) - {WIDTH - 1})) AS pos, w FROM d WHERE len(w) >= {WIDTH}),
hits AS (SELECT g.doc_id, g.n, g.pos, t.template, t.gram FROM g JOIN tpl t ON t.gram = array_to_string(g.w[pos + 1 : pos + {WIDTH}], ' ')),
near AS (SELECT *, unnest([pos // {half}, pos // {half} - 1]) AS win FROM hits),
held AS (SELECT doc_id, template, win, count(DISTINCT gram) AS c FROM near
 WHERE win >= 0 AND win * {half} <= greatest(0, n - {half} - 1) GROUP BY doc_id, template, win)
SELECT doc_id, h.template, min(win * {half})::BIGINT AS first_word, count(*) AS n_windows, round(max(c / s.n), 4) AS containment
FROM held h JOIN sizes s ON s.template = h.template WHERE 100 * c >= {percent} * s.n GROUP BY doc_id, h.template"""
