"""The ledger's ids against a run book by book."""

import random

import pytest

from lectern.operators import ledger as L
from lectern.sources.sinks import Store

BOOK = "ord int, key string, source_ref string, sha256 string"


def one_by_one(held, batch):
    """(matched_by, id of a living book or None, twin) of each book, and which books of the batch share a new id."""
    rows, claimed, out, made = list(held), set(), {}, {}
    for ord_, key, ref, sha in batch:
        by_key = next((r for r in rows if r[1] == key), None)
        by_ref = next((r for r in held if ref and r[2] == ref and r[0] not in claimed), None)
        if by_key:
            out[ord_] = ("key", by_key[0], None)
        elif key in made:
            out[ord_] = ("key", made[key], None)
        elif by_ref:
            out[ord_] = ("source", by_ref[0], None)
        else:
            twins = sorted(r[1] for r in held if sha and r[3] == sha and r[0] not in claimed)
            out[ord_] = ("new", f"new {key}", twins[0] if twins else None)
        made.setdefault(key, out[ord_][1])
        claimed.add(out[ord_][1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_resolve_is_a_run_book_by_book(spark, seed):
    rng = random.Random(seed)
    held = [(f"b{i}", f"k{i}", f"r{i}", f"s{rng.randrange(8)}") for i in range(20)]
    batch = [(i, f"k{rng.randrange(40)}", rng.choice(["", f"r{rng.randrange(30)}"]), rng.choice(["", f"s{rng.randrange(10)}"])) for i in range(60)]
    table = L.with_fields(spark.createDataFrame(held, "book_id string, key string, source_ref string, sha256 string"))
    got = {r.ord: r for r in L.resolve(table, spark.createDataFrame(batch, BOOK)).collect()}
    want, ids = one_by_one(held, batch), {}
    assert len(got) == len(batch)
    for ord_, (how, book_id, twin) in want.items():
        assert (got[ord_].matched_by, got[ord_].twin) == (how, twin), ord_
        if book_id.startswith("new "):
            assert ids.setdefault(book_id, got[ord_].book_id) == got[ord_].book_id and got[ord_].book_id not in {h[0] for h in held}
        else:
            assert got[ord_].book_id == book_id
    assert len(set(ids.values())) == len(ids)


def test_a_renamed_and_moved_book_keeps_its_row_when_its_old_name_returns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FREE_IDS", 2)
    books = L.Ledger(Store(spark, f"file://{tmp_path}"))
    made = lambda rows: spark.createDataFrame(rows, BOOK)

    def take(key, ref):
        batch = made([(1, key, ref, "")])
        found = L.resolve(books.rows(), batch).first()
        books.begin(spark.createDataFrame([(found.book_id, key, ref, "")], "book_id string, key string, source_ref string, sha256 string"), "t")
        return found.book_id

    seen = [take("K1", "x.txt")]
    for n in range(3):  # renamed in its place, then moved: the next book is the old name at the old place; ids run out
        assert take(f"M{n}", "x.txt") == seen[-1]
        assert take(f"M{n}", f"y{n}.txt") == seen[-1]
        seen.append(take("K1", "x.txt"))
        assert len(set(seen)) == n + 2
    assert books.rows().count() == 4 and {r.key for r in books.rows().collect()} == {"K1", *[f"M{n}" for n in range(3)]}


def test_backfill_has_a_row_for_each_key(spark, tmp_path):
    books = L.Ledger(Store(spark, f"file://{tmp_path}"))
    rows = spark.createDataFrame([("n2", "A — X"), ("n1", "A — X"), (None, "A — X"), (None, "B"), ("", "B"), ("n3", ""), ("n3", None)], "note string, book string")
    assert books.backfill(rows, "t", "model") == 2
    got = {r.key: r for r in books.rows().collect()}
    assert {k: (r.source_ref, r.chunker, r.status, r.embedding_model, r.rows) for k, r in got.items()} == {"A — X": ("note:n1", "legacy", "indexed", "model", 3), "B": ("", "legacy", "indexed", "model", 2)}
    assert all(r.book_id for r in got.values()) and got["A — X"].title == "A"
    again = books.backfill(rows.union(spark.createDataFrame([("n9", "C")], rows.schema)), "t2")
    assert again == 3 and {r.key: r.book_id for r in books.rows().where("key <> 'C'").collect()} == {k: r.book_id for k, r in got.items()}
