import random

import pytest

from lectern.operators import outline as O


@pytest.mark.parametrize("or_at", [False, True])
@pytest.mark.parametrize("span", [7, 10**6])
def test_last_before_is_a_look_back(spark, or_at, span):
    rng = random.Random(span)
    at = lambda: rng.choice([None, *range(60)])
    points = [(rng.choice(["a", "b", "lone", None]), at(), i) for i in range(300)]
    marks = [(rng.choice(["a", "b", None, "other"]), at(), rng.choice([None, "x", "y", "z"])) for _ in range(40)]
    got = O.last_before(spark.createDataFrame(points, "k string, at long, i int"), spark.createDataFrame(marks, "k string, at long, value string"), ["k"], or_at, span)
    got = {r.i: r.mark for r in got.collect()}
    assert len(got) == len(points)
    for k, a, i in points:
        before = [(m, v) for key, m, v in marks if key == k and None not in (a, m, v) and (m < a or or_at and m == a)]
        assert got[i] == (max(before)[1] if before else None), (k, a)


def test_chapters_carry_their_part(spark):
    text = "PART ONE.\n\nCHAPTER I\nx\nCHAPTER II\ny\nPART  TWO\nCHAPTER I\nz\n"
    rows = [("b", text), ("c", "CHAPTER I\nalone"), ("d", "PART ONE"), ("e", None)]
    books = spark.createDataFrame(rows, "note string, text string")
    got = sorted((r.note, r["at"], r.title) for r in O.chapters_in_parts(books, r"^CHAPTER [IVX]+$", r"^PART\s+[A-Z]+\.?$").collect())
    assert [(n, t) for n, _, t in got] == [("b", "PART ONE — CHAPTER I"), ("b", "PART ONE — CHAPTER II"), ("b", "PART TWO — CHAPTER I"), ("c", "CHAPTER I")]
    assert all(dict(rows)[n][a:].startswith("CHAPTER") for n, a, _ in got)
    picked = O.chapters_in_parts(books, r"^CHAPTER ([IVX]+)$", r"^PART\s+([A-Z]+)").where("note = 'b'").orderBy("at").collect()
    assert [r.title for r in picked] == ["ONE — I", "ONE — II", "TWO — I"]


def test_pages_fall_to_the_outline(spark):
    pages = spark.createDataFrame([("b", p) for p in range(1, 8)] + [("c", 1)], "note string, page int")
    outline = spark.createDataFrame([("b", 2, "One", 1), ("b", 4, "Two", 2), ("b", 4, "Two A", 3), ("b", 99, "End", 4)], "note string, page int, title string, ordinal int")
    got = {(r.note, r.page): r.section for r in O.sections_of_pages(pages, outline).collect()}
    assert got == {("b", 1): None, ("b", 2): "One", ("b", 3): "One", ("b", 4): "Two A", ("b", 5): "Two A", ("b", 6): "Two A", ("b", 7): "Two A", ("c", 1): None}
