"""Which titles many texts mention, and what a question asks about beside the titles that it names.

All titles are looked for in one pass over a text by an Aho-Corasick automaton; there is no join of texts with titles.
A catalogue of more than BLOCK_CHARS characters of titles is looked for in blocks, one automaton and one pass each, so
that what is broadcast stays within that bound."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Characters of titles in one automaton, about.
BLOCK_CHARS = 4_000_000

#: Words that ask about a book's content and not about holding it, as one pattern (any case, whole words).
CONTENT_WORDS = (
    r"why|how(?!\s+many)|who(?!\s+(?:wrote|authored|(?:is|are)\s+(?:the|their)\s+authors?))|whom|whose|where|when|what happens|explain|describe|tell me about|"
    r"summar\w*|plot|character\w*|about|mention\w*|discuss\w*|deals? with|"
    r"чому|як(?!\s+багато)|хто(?!\s+(?:\w+\s+)?(?:написав|написала|автор|авторка|автори))|кого|де|коли|про що|про|поясни|розкажи|опиши|сюжет|згаду\w*|йдеться"
)

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(titles, name: str) -> ahocorasick.Automaton:
    """The automaton of a broadcast block of that name, built once in each worker."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        found = ahocorasick.Automaton()
        for t in titles.value:
            found.add_word(t, t)
        found.make_automaton()
        _AUTOMATA[name] = found
    return _AUTOMATA[name]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def occurrences(automaton: ahocorasick.Automaton, text: str, whole: bool, longest: bool, apart: bool = False) -> list[tuple[str, int, int]]:
    """(title, start, end) in a lowered text, by start; with longest, without those inside a longer one. apart:
    those of one title do not overlap; each is looked for after the one before it, and then tested for whole words."""
    found, after = [], {}
    for last, title in automaton.iter(text):
        start, end = last + 1 - len(title), last + 1
        if apart:
            if start < after.get(title, 0):
                continue
            after[title] = end
        if whole and ((start and _word(text[start - 1]) and _word(title[0])) or (end < len(text) and _word(text[end]) and _word(title[-1]))):
            continue
        found.append((title, start, end))
    found.sort(key=lambda x: (x[1], -x[2]))
    if longest:
        kept, reach = [], -1
        for f in found:
            if f[2] > reach:
                kept.append(f)
                reach = f[2]
        found = kept
    return found


def _search(titles, whole: bool, longest: bool, apart: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(titles, name)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1)):
                hits = occurrences(automaton, (text.as_py() or "").lower(), whole, longest, apart)
                ids.extend([i] * len(hits))
                rows.extend(hits)
            title, start, end = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(title, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "folded", "start", "end"])

    return run


def mentions(texts: DataFrame, titles: DataFrame, whole: bool = True, longest: bool = True, apart: bool = False) -> DataFrame:
    """(doc_id, title, n, first): how often a text (doc_id long, text) mentions a title (title), in any case, and where first.

    whole: as whole words (a title that begins or ends with a mark needs no gap there). longest: a title inside the mention
    of a longer one is not mentioned. Titles that differ in case share their mentions; blank and null ones have none, nor
    have null texts. Overlapping occurrences of one title count each, unless apart: then they are those of a split of the text
    by the title."""
    spark = texts.sparkSession
    names = titles.select("title").where("title is not null").distinct().withColumn("folded", F.lower(F.trim("title"))).where("folded <> ''")
    folded = names.select("folded").distinct()
    blocks = -(-(folded.agg(F.sum(F.char_length("folded"))).first()[0] or 0) // BLOCK_CHARS)
    found = None
    for b in range(blocks):
        block = [r[0].lower() for r in folded.where(F.pmod(F.xxhash64("folded"), F.lit(blocks)) == b).collect()]
        hits = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_search(spark.sparkContext.broadcast(block), whole, longest, apart), "doc_id long, folded string, start long, end long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, title string, n long, first long")
    if longest and blocks > 1:  # a longer title may be of another block
        before = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("reach", F.max("end").over(before)).where("reach is null or end > reach")
    counted = found.groupBy("doc_id", "folded").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    return counted.join(names, "folded").select("doc_id", "title", "n", "first")


def books_named(questions: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, book) of the books (book) whose title or whose author's last name a question (doc_id, text) holds as whole
    words. A name inside a longer one counts, as each book is asked about by itself. A book met by its author is left out
    where its title is met too, so that rows are single as they are made and need not be compared with each other."""
    names = books.select("book").where("book is not null").distinct()
    own = F.coalesce(X.title_of(F.col("book")), F.lit(""))
    surname = F.regexp_extract(X.author_of(F.col("book")), r"(\S+)\s*$", 1)
    keys = F.array(F.struct(own.alias("title"), F.lit("").alias("own")), F.struct(surname.alias("title"), own.alias("own")))
    keyed = names.select("book", F.inline(keys)).where("title <> '' and title <> own")
    held = mentions(questions, keyed, longest=False).groupBy("doc_id").agg(F.collect_set("title").alias("titles"))
    met = held.select("doc_id", "titles", F.explode("titles").alias("title")).join(keyed, "title")
    return met.where(~F.array_contains("titles", F.col("own"))).select("doc_id", "book")


def books_in_window(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected title (query_id, title) of a query: found, whether a hit's book (query_id, rank, book) holds it in any case,
    and best_rank, the first such hit's. Titles meet only the hits of their query."""
    met = expected.select("query_id", "title").distinct().join(hits.select("query_id", "rank", F.lower("book").alias("book")), "query_id", "left")
    inside = F.when(F.contains(F.col("book"), F.lower("title")), F.col("rank"))
    return met.groupBy("query_id", "title").agg(F.min(inside).alias("best_rank")).withColumn("found", F.col("best_rank").isNotNull())


def content_clue(question: Column) -> Column:
    """The first word of a question that asks about content, or '' if it reads as one about holdings."""
    plain = F.trim(F.regexp_replace(F.lower(question), r"(?U)\s+", " "))
    return F.coalesce(F.regexp_extract(plain, rf"(?iU)(?<!\w)(?:{CONTENT_WORDS})(?!\w)", 0), F.lit(""))


def mixed_intent(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests (ask_id, question, title) with clue and mixed: whether they ask about content beside the title. One occurrence
    of the title is left out first, if the title means exactly one held book (resolved: ask_id and books)."""
    sole = resolved.where("books = 1").select("ask_id", F.lit(True).alias("_sole"))
    both = requests.join(sole, "ask_id", "left")
    at = F.instr(F.lower("question"), F.lower("title"))
    cut = F.overlay("question", F.lit(" "), at, F.char_length("title"))
    rest = F.when(F.coalesce(F.col("_sole"), F.lit(False)) & (F.col("title") != "") & (at > 0), cut).otherwise(F.col("question"))
    return both.withColumn("clue", content_clue(rest)).withColumn("mixed", F.col("clue") != "").drop("_sole")
