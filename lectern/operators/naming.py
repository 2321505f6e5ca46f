"""Names, headings and requests: which rows a name means, whether a question names a book, what a search repeats,
where back matter begins, and what a planner's reply asks of the catalogue."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X

#: The numbering before a heading, strings that count as true, refusals carried forward.
NUMBERING = r"^(?:(?i:chapter|part|appendix)\s+)?(?:\d+(?:\.\d+)*[.\-):]?\s+|[IVXLC]+[.\-):]\s*|[A-F][.\-):]\s*)?"
TRUE_STRINGS = ("true", "yes", "1")
REFUSALS_SHOWN = 6

_SPACE = r"\s\x1C-\x1F"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+\z", "")


def rows_for_names(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (with a column book) of each asked name (ask_id, name): those whose key it is, else those whose title it is.

    An equi-join on keys and titles, never a prefix. Whether a name is a key is settled before it meets rows, so what is
    found, which grows with the rows of a name times those that ask for it, is not moved again. A null name or book matches
    nothing."""
    names = asked.select("name").where("name is not null").distinct()
    keys = rows.select(F.col("book").alias("name")).distinct()
    exact = names.join(keys, "name", "left_semi").select("name", F.lit(False).alias("_by_title"))
    kinds = exact.unionByName(names.join(keys, "name", "left_anti").select("name", F.lit(True).alias("_by_title")))
    wanted = asked.select("ask_id", "name").join(kinds, "name").select("ask_id", F.col("name").alias("_key"), "_by_title")
    keyed = rows.withColumn("_key", F.col("book")).withColumn("_by_title", F.lit(False))
    titled = rows.withColumn("_key", X.title_of(F.col("book"))).withColumn("_by_title", F.lit(True)).where("_key <> book")
    # rows are dealt evenly first, as a few titles can have most of them
    dealt = keyed.unionByName(titled).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return wanted.join(dealt, ["_key", "_by_title"]).drop("_key", "_by_title")


def names_book(wanted: Column, key: Column) -> Column:
    return (wanted == key) | (wanted == X.title_of(key))


def is_loop_marker(query: Column) -> Column:
    """Whether a query is one of the loop's own markers; false for null."""
    return F.coalesce(_strip(query).startswith("__"), F.lit(False))


def named_in(question: Column, book: Column) -> Column:
    """Whether a question holds a book's title or its author's last name, as whole words in any case."""
    asked = F.lower(question)

    def whole(phrase: Column) -> Column:
        quoted = F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        return (phrase != "") & F.rlike(asked, F.concat(F.lit("(?U)(?<!\\w)\\Q"), quoted, F.lit("\\E(?!\\w)")))

    surname = F.regexp_extract(F.lower(X.author_of(book)), r"(\S+)\s*$", 1)
    return whole(F.lower(X.title_of(book))) | whole(surname)


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def search_key(query: Column) -> Column:
    """What spellings of one search share: composed, case folded, spaces collapsed, punctuation stripped at both ends.
    ASCII queries stay in the JVM."""
    folded = F.coalesce(_folded(F.when(F.octet_length(query) != F.char_length(query), query)), F.lower(query))
    return F.regexp_replace(F.regexp_replace(folded, rf"(?U)[{_SPACE}]+", " "), r"^[ \p{P}]+|[ \p{P}]+\z", "")


def effective_book(chosen: Column, book_filter: Column) -> Column:
    """The book that a search is limited to: the one chosen on asking back, else the one named; empty for all."""
    return F.coalesce(F.nullif(chosen, F.lit("")), F.nullif(book_filter, F.lit("")), F.lit(""))


def new_searches(searches: DataFrame) -> DataFrame:
    """The first step of each different search (run, step, query, book) of a run: run, key, book, step. Markers and
    queries without a key are no searches."""
    keyed = searches.where(~is_loop_marker(F.col("query"))).select("run", "step", search_key(F.col("query")).alias("key"), F.coalesce("book", F.lit("")).alias("book"))
    return keyed.where("key <> ''").groupBy("run", "key", "book").agg(F.min("step").alias("step"))


def evidence_of_choice(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence (run, book) that stays after asking back (run, asked, chosen): the chosen book's. All of it stays where
    nothing was asked or the reply named no candidate (unresolved)."""
    held = evidence.join(runs.select("run", "asked", "chosen"), "run", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    kept = held.where(~F.col("asked") | F.col("chosen").isNull() | (F.col("book") == F.col("chosen")))
    return kept.withColumn("unresolved", F.col("asked") & F.col("chosen").isNull()).drop("asked", "chosen")


def last_refusals(refusals: DataFrame, most: int = REFUSALS_SHOWN) -> DataFrame:
    """The last refusals (run, step) of each run."""
    latest = Window.partitionBy("run").orderBy(F.desc("step"))
    return refusals.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= most).drop("_n")


def embedding_text(book: Column, section: Column, text: Column) -> Column:
    """A chunk's text under its book and, where it has one, its section."""
    return F.concat(book, F.coalesce(F.concat(F.lit(X.SEPARATOR), F.nullif(section, F.lit(""))), F.lit("")), F.lit("\n"), text)


def heading_title(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(heading, r"(?U)\s+", " "), r"^[ \]]+|[ \]]+\z", "")


def same_heading(one: Column, other: Column) -> Column:
    """Whether two headings are equal but for case and the numbering before them."""
    bare = lambda c: F.lower(F.regexp_replace(_strip(c), NUMBERING, ""))
    return bare(one) == bare(other)


def cut_back_matter(sections: DataFrame, pattern: str, title: str | None = None) -> DataFrame:
    """Sections (book, n, title, body) with the back matter of each book's last one in a section of its own, and
    whether the book was cut.

    Back matter begins at the first line-wise match of the pattern. Its section has the matched heading as its title,
    or the given title and then keeps the heading in its body. Nothing moves where no text follows the match; a last
    section that is all back matter is replaced. Null bodies are never cut."""
    whole = "(?m)" + pattern
    last = Window.partitionBy("book")
    placed = sections.select("book", "n", "title", "body", (F.col("n") == F.max("n").over(last)).alias("_last"))
    at = F.regexp_instr("body", F.lit(whole))
    heading = F.regexp_extract("body", whole, 0)
    parts = placed.withColumn("_at", F.when(F.col("_last"), at).otherwise(0)).withColumn("_heading", heading)
    parts = parts.withColumn("_before", _strip(F.expr("left(body, _at - 1)"))).withColumn("_after", _strip(F.expr("substr(body, _at + char_length(_heading))")))
    back = F.struct(
        (F.col("n") + F.when(F.col("_before") == "", 0).otherwise(1)).cast("long").alias("n"),
        (F.lit(title) if title else heading_title(F.col("_heading"))).alias("title"),
        (_strip(F.expr("substr(body, _at)")) if title else F.col("_after")).alias("body"),
    )
    own = lambda body: F.struct(F.col("n").cast("long").alias("n"), F.col("title").alias("title"), body.alias("body"))
    cut = F.coalesce((F.col("_at") > 0) & (F.col("_after") != ""), F.lit(False))
    split = F.when(~cut, F.array(own(F.col("body")))).when(F.col("_before") == "", F.array(back)).otherwise(F.array(own(F.col("_before")), back))
    return parts.withColumn("cut", F.bool_or(cut).over(last)).select("book", F.inline(split), "cut")


def _typed(payload: Column, key: str, kind: str) -> Column:
    value = F.try_variant_get(payload, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == kind.upper(), F.try_variant_get(payload, f"$.{key}", kind))


def str_field(payload: Column, key: str, choices: tuple[str, ...] | None = None) -> Column:
    """A field of a variant where it is a string with text (one of the choices, if given); else null."""
    value = _typed(payload, key, "string")
    fits = _strip(value) != ""
    return F.when(fits & value.isin(*choices) if choices else fits, value)


def bool_field(payload: Column, key: str) -> Column:
    """Whether a field of a variant is true, or a string that says so; false for all else."""
    said = F.lower(_strip(_typed(payload, key, "string"))).isin(*TRUE_STRINGS)
    return F.coalesce(_typed(payload, key, "boolean"), said, F.lit(False))


def catalogue_request(reply: Column, ops: tuple[str, ...]) -> Column:
    """Struct (op, title, author) of a planner's reply in JSON; null without an operation of the catalogue's, for "has"
    without a title and for "by_author" without an author."""
    payload = F.try_parse_json(reply)
    op = str_field(payload, "catalog.op", ops)
    title, author = (F.coalesce(_strip(_typed(payload, f"catalog.{k}", "string")), F.lit("")) for k in ("title", "author"))
    lacking = ((op == "has") & (title == "")) | ((op == "by_author") & (author == ""))
    return F.when(op.isNotNull() & ~lacking, F.struct(op.alias("op"), title.alias("title"), author.alias("author")))
