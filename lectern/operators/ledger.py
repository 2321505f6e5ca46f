"""The ledger of books: a row for each book that was asked for, and its reconciliation with what is indexed.

A ledger is a table of FIELDS in a Store. Batches of books are resolved, begun, committed and failed as DataFrames; each
write replaces the rows of the books that it names and is published in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.sinks import Store

# The states of a book, and the length of a recorded error.
REQUESTED, INDEXED, FAILED = "requested", "indexed", "failed"
LONGEST_ERROR = 500
LEGACY = "legacy"
#: Ids that a new book's key and reference make, tried in turn.
FREE_IDS = 8
FIELDS = {
    "book_id": "string", "key": "string", "title": "string", "author": "string", "source_ref": "string", "sha256": "string", "chunker": "string", "embedding_model": "string",
    "status": "string", "error": "string", "rows": "long", "fts_seconds": "double", "requested_at": "string", "indexed_at": "string",
}
SCHEMA = ", ".join(f"`{k}` {v}" for k, v in FIELDS.items())
_NUMBERS = {"rows": 0, "fts_seconds": 0.0}


def with_fields(rows: DataFrame) -> DataFrame:
    """All FIELDS in order; those that are missing or null are empty or zero. Other columns are an error."""
    if unknown := set(rows.columns) - set(FIELDS):
        raise ValueError(f"not fields of a ledger: {sorted(unknown)}")
    return rows.select(*[F.coalesce(F.col(f"`{k}`").cast(t) if k in rows.columns else F.lit(None).cast(t), F.lit(_NUMBERS.get(k, ""))).alias(k) for k, t in FIELDS.items()])


def resolve(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """(ord, book_id, matched_by, twin) of incoming books (ord, key, source_ref, sha256).

    'key': the ledger, or an earlier book of the batch, has the key. Else 'source': the book whose source_ref is the same
    keeps its id, unless an earlier book of the batch has claimed it. Else 'new', an id made from the key and the reference
    that no living book has: ids stay with books that were renamed and moved since, so the first FREE_IDS that key and
    reference make are tried, and beyond them a random one is taken (write the result before using it twice).
    A digest adopts nothing: twin is the least key of a ledger row with the same text, for a new book; rows whose id an
    earlier book of the batch has got are no twins."""
    held = ledger.groupBy("key").agg(F.min("book_id").alias("by_key"))
    place = ledger.where("source_ref <> ''").groupBy("source_ref").agg(F.min("book_id").alias("by_ref"))
    found = incoming.join(held, "key", "left").join(place, "source_ref", "left")
    # the first of a key in the batch decides for the others
    first = F.row_number().over(Window.partitionBy("key").orderBy("ord")) == 1
    found = found.withColumn("first", first)
    claimed = found.withColumn("claims", F.coalesce("by_key", F.when(F.col("first"), F.col("by_ref"))))
    # an id goes to the earliest of those that claim it by key or by source
    turn = F.row_number().over(Window.partitionBy("claims").orderBy("ord"))
    claimed = claimed.withColumn("adopts", F.col("by_key").isNull() & F.col("first") & F.col("by_ref").isNotNull() & (turn == 1))
    matched = F.when(F.col("by_key").isNotNull() | ~F.col("first"), "key").when(F.col("adopts"), "source").otherwise("new")
    decided = claimed.select("ord", "key", "source_ref", "sha256", "first", matched.alias("matched_by"), F.coalesce("by_key", F.when(F.col("adopts"), F.col("by_ref"))).alias("kept"))
    # ids for new books: candidates that the ledger lacks
    tries = F.transform(F.sequence(F.lit(0), F.lit(FREE_IDS - 1)), lambda n: F.struct(n.alias("n"), new_id(F.col("key"), F.col("source_ref"), n).alias("id")))
    tried = decided.where("matched_by = 'new'").select("key", F.explode(tries).alias("t")).select("key", "t.*")
    free = tried.join(ledger.select(F.col("book_id").alias("id")).distinct(), "id", "left_anti").groupBy("key").agg(F.min_by("id", "n").alias("free"))
    heads = decided.where("first").join(free, "key", "left").select("key", F.coalesce("kept", "free", F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))).alias("book_id"))
    out = decided.join(heads, "key").select("ord", "book_id", "matched_by", "sha256")
    # a twin's row must not be one that the batch took over before this book: its first taker comes later, or none does
    taken = out.where("matched_by <> 'new'").groupBy("book_id").agg(F.min("ord").alias("taken"))
    texts = ledger.where("sha256 <> ''").select("sha256", "book_id", F.col("key").alias("same_text")).join(taken, "book_id", "left").drop("book_id")
    new = out.where("matched_by = 'new'").select("ord", "sha256").join(texts, "sha256").where("taken is null or taken > ord").groupBy("ord").agg(F.min("same_text").alias("twin"))
    return out.join(new, "ord", "left").select("ord", "book_id", "matched_by", "twin")


def new_id(key: Column, source_ref: Column, n: Column) -> Column:
    """The n-th id that a key and a reference make."""
    return F.md5(F.concat_ws("\x1f", key, source_ref, F.when(n > 0, n.cast("string"))))


def diff(ledger: DataFrame, files: DataFrame, scope: str = "") -> DataFrame:
    """(path, book_id, state) of a folder's files (path, key, source_ref) against the ledger: known by key, else by
    reference; new; and vanished: a ledger row of this scope (the tag of its local reference) that no file is."""
    keys = ledger.where("key <> ''").groupBy("key").agg(F.min("book_id").alias("by_key"))
    refs = ledger.where("source_ref <> ''").groupBy("source_ref").agg(F.min("book_id").alias("by_ref"))
    found = files.join(keys, "key", "left").join(refs, "source_ref", "left").select("path", F.coalesce("by_key", "by_ref").alias("book_id"))
    local = ledger.withColumn("at", X.local_ref(F.col("source_ref"))).where(F.col("at").isNotNull() & ((F.col("at.tag") == scope) if scope else F.lit(True)))
    here = files.select(F.col("path").alias("p")).distinct()
    gone = local.join(found.select("book_id").where("book_id is not null").distinct(), "book_id", "left_anti").join(here, F.col("at.path") == F.col("p"), "left_anti")
    states = found.withColumn("state", F.when(F.col("book_id").isNull(), "new").otherwise("known"))
    return states.unionByName(gone.select(F.col("at.path").alias("path"), "book_id", F.lit("vanished").alias("state")))


def missing(ledger: DataFrame) -> DataFrame:
    """Books that were requested and never indexed."""
    return ledger.where(F.col("status") != INDEXED)


def check(ledger: DataFrame, rows: DataFrame, cards: DataFrame) -> DataFrame:
    """(kind, name, found, expected) of all that the ledger and the indexed rows (book, book_id) and cards (book) disagree
    about; empty if they agree.

    never_indexed, indexed_but_absent, row_count_drift: books of the ledger by their rows' number; duplicate_key: one key,
    several ids; not_in_ledger, card_without_book: keys of rows, and of cards alone, that the ledger lacks; orphan_rows:
    rows whose id is empty or of no ledger row."""
    counts = rows.groupBy("book_id").agg(F.count("*").alias("found"))
    books = ledger.select("book_id", "key", "status", "rows").join(counts.where("book_id <> ''"), "book_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    kind = (
        F.when(F.col("status") != INDEXED, "never_indexed").when(F.col("found") == 0, "indexed_but_absent")
        .when((F.col("rows") != 0) & (F.col("rows") != F.col("found")), "row_count_drift")
    )
    name = F.coalesce(F.nullif("key", F.lit("")), F.lit("(no key)")).alias("name")
    none = F.lit(None).cast("long").alias("expected")
    drift = books.select(kind.alias("kind"), name, "found", F.col("rows").alias("expected")).where("kind is not null")
    twice = ledger.select(name, "book_id").groupBy("name").agg(F.count_distinct("book_id").alias("found")).where("found > 1")
    text = rows.where("book <> ''").groupBy(F.col("book").alias("name")).agg(F.count("*").alias("in_text"))
    card = cards.where("book <> ''").groupBy(F.col("book").alias("name")).agg(F.count("*").alias("in_cards"))
    alone = text.join(card, "name", "full_outer").join(ledger.select(name).distinct(), "name", "left_anti")
    alone = alone.select(F.when(F.col("in_text").isNotNull(), "not_in_ledger").otherwise("card_without_book").alias("kind"), "name", F.coalesce("in_text", "in_cards").alias("found"), none)
    known = ledger.select("book_id").distinct()
    orphans = counts.join(known, "book_id", "left_anti").groupBy(F.when(F.coalesce("book_id", F.lit("")) == "", "no book_id").otherwise("unknown book_id").alias("name")).agg(F.sum("found").alias("found"))
    parts = [drift, twice.select(F.lit("duplicate_key").alias("kind"), "name", "found", none), alone, orphans.select(F.lit("orphan_rows").alias("kind"), "name", "found", none)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recovery(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """(book_id, outcome) of every book, by its rows (book_id, book_rev) after an interruption.

    settled: indexed; nothing_written: no rows; mixed_revisions: rows of several; complete: all expected rows of the
    revision being written (sha256); partial: some of them; stale: rows of another revision only."""
    held = rows.groupBy("book_id").agg(F.count("*").alias("n"), F.min("book_rev").alias("lo"), F.max("book_rev").alias("hi"))
    all_of = ledger.select("book_id", "status", "sha256", "rows").join(held, "book_id", "left")
    outcome = (
        F.when(F.col("status") == INDEXED, "settled").when(F.col("n").isNull(), "nothing_written").when(F.col("lo") != F.col("hi"), "mixed_revisions")
        .when(F.col("lo") != F.col("sha256"), "stale").when(F.col("n") >= F.col("rows"), "complete").otherwise("partial")
    )
    return all_of.select("book_id", outcome.alias("outcome"))


class Ledger:
    """A ledger kept in a Store under a name."""

    def __init__(self, store: Store, name: str = "books") -> None:
        self.store, self.name = store, name

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def rows(self) -> DataFrame:
        found = self.store.read(self.name)
        return found if found is not None else self.spark.createDataFrame([], SCHEMA)

    def put(self, rows: DataFrame) -> int:
        """Replace the rows of these books (by book_id), and add the others. A batch has a book once: the greatest
        requested_at, then the greatest key, stays. Returns the ledger's size."""
        order = Window.partitionBy("book_id").orderBy(F.desc("requested_at"), F.desc("key"))
        new = with_fields(rows).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        return self.store.upsert(self.name, new, ["book_id"])

    def _changed(self, books: DataFrame, changes: dict[str, Column], create: bool = False) -> int:
        """Put rows of FIELDS made from the ledger's (columns old.x) and the batch's (new.x). Books that the ledger lacks
        are an error unless they are to be created."""
        both = self.rows().alias("old").join(books.alias("new"), F.col("old.book_id") == F.col("new.book_id"), "right")
        if not create and (lost := both.where("old.book_id is null").select("new.book_id").limit(1).collect()):
            raise KeyError(f"no ledger row for {lost[0][0]}")
        return self.put(both.select(*[changes.get(k, F.coalesce(F.col(f"old.{k}"), F.lit(_NUMBERS.get(k, "")))).alias(k) for k in FIELDS]))

    def begin(self, books: DataFrame, now: str, chunker: str = "", embedding_model: str = "") -> int:
        """Mark books (book_id, key, source_ref, sha256) as being written. What a batch leaves empty stays as it was."""
        kept = lambda k: F.coalesce(F.nullif(F.col(f"new.{k}"), F.lit("")), F.col(f"old.{k}"), F.lit(""))
        fixed = {"status": REQUESTED, "error": "", "requested_at": now, "chunker": chunker, "embedding_model": embedding_model}
        changes = {k: kept(k) for k in ("key", "source_ref", "sha256")} | {k: F.lit(v) for k, v in fixed.items()}
        return self._changed(books, changes | {"book_id": F.col("new.book_id"), "title": X.title_of(kept("key")), "author": X.author_of(kept("key"))}, create=True)

    def commit(self, books: DataFrame, now: str, fts_seconds: float = 0.0) -> int:
        """Mark books (book_id, rows) as indexed with so many rows."""
        fixed = {"status": F.lit(INDEXED), "error": F.lit(""), "indexed_at": F.lit(now), "fts_seconds": F.lit(fts_seconds), "rows": F.col("new.rows").cast("long")}
        return self._changed(books, fixed)

    def fail(self, books: DataFrame) -> int:
        """Mark books (book_id, error) as failed; an error is one line of LONGEST_ERROR characters at most."""
        line = F.left(F.trim(F.regexp_replace("new.error", r"\s+", " ")), F.lit(LONGEST_ERROR))
        return self._changed(books, {"status": F.lit(FAILED), "error": line})

    def backfill(self, rows: DataFrame, now: str, embedding_model: str = "") -> int:
        """A ledger from rows (note, book) of an index that had none: one indexed book for each key, its reference the least
        note of its rows (none: empty), its chunker LEGACY. Keys that the ledger has are left alone. Returns the ledger's size."""
        found = rows.where("book <> ''").groupBy(F.col("book").alias("key")).agg(F.min(F.nullif("note", F.lit(""))).alias("note"), F.count("*").alias("rows")).join(self.rows().select("key"), "key", "left_anti")
        ref = F.coalesce(F.concat(F.lit("note:"), "note"), F.lit(""))
        ids = found.withColumn("source_ref", ref).select("key", "source_ref", "rows", F.explode(F.sequence(F.lit(0), F.lit(FREE_IDS - 1))).alias("n")).withColumn("book_id", new_id(F.concat(F.lit("legacy:"), "key"), F.col("source_ref"), F.col("n")))
        ids = ids.join(self.rows().select("book_id"), "book_id", "left_anti").groupBy("key", "source_ref", "rows").agg(F.min_by("book_id", "n").alias("book_id"))
        new = ids.select("book_id", "key", X.title_of(F.col("key")).alias("title"), X.author_of(F.col("key")).alias("author"), "source_ref", "rows")
        fixed = {"chunker": LEGACY, "embedding_model": embedding_model, "status": INDEXED, "requested_at": now, "indexed_at": now}
        return self.put(new.withColumns({k: F.lit(v) for k, v in fixed.items()}))
