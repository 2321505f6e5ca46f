import random
import re

import pytest

from lectern.operators import mentions as M
from lectern.operators import naming

TITLES = ["Dracula", "Dracula's Guest", "It", "The Long Road", "long road", "C++", "  ", None, "Über", "a_b", "The Road", "road the road"]
PIECES = ["dracula", "Dracula's Guest", "its", "it", "IT", "the long road", "the  long road", "c++", "c+++", "xc++", "über", "ÜBER", "überall", "a_b", "a_b_c", "road", "the road the road the road", ",", "—", "\n"]


def plain(text, whole, longest):
    t, found = (text or "").lower(), []
    for title in {x.strip().lower() for x in TITLES if x and x.strip()}:
        for m in re.finditer(f"(?={re.escape(title)})", t):
            a, b = m.start(), m.start() + len(title)
            left = a and re.match(r"\w", t[a - 1]) and re.match(r"\w", title[0])
            right = b < len(t) and re.match(r"\w", t[b]) and re.match(r"\w", title[-1])
            if not (whole and (left or right)):
                found.append((title, a, b))
    if longest:
        found = [f for f in found if not any(o[1] <= f[1] and o[2] >= f[2] and o[2] - o[1] > f[2] - f[1] for o in found)]
    out = {}
    for title, a, _ in found:
        n, first = out.get(title, (0, a))
        out[title] = (n + 1, min(first, a))
    return out


@pytest.mark.parametrize("block", [10**6, 20])
def test_mentions_are_those_of_each_title_looked_for_alone(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_CHARS", block)
    rng = random.Random(2)
    texts = [(i, rng.choice(["", " "]).join(rng.choice(PIECES) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(900, None), (901, "It " * 200)]
    rows, titles = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in TITLES], "title string")
    for whole in (True, False):
        for longest in (True, False):
            got = {(r.doc_id, r.title): (r.n, r["first"]) for r in M.mentions(rows, titles, whole, longest).collect()}
            want = {(i, t): found[t.strip().lower()] for i, x in texts for found in [plain(x, whole, longest)] for t in TITLES if t and t.strip().lower() in found}
            assert got == want
    assert M.mentions(rows, titles.limit(0)).count() == 0 and M.mentions(rows.limit(0), titles).count() == 0


def test_books_named_is_named_in_of_all_pairs(spark):
    books = [("Dracula — Bram Stoker",), ("The Long Road — J. Doe",), ("Über alles — Ann",), ("Notes",), ("C++ — B. Stroustrup",)]
    asked = [(1, "Did Stoker write of roads?"), (2, "is dracula by doe"), (3, "the LONG road"), (4, "über alles, Ann?"), (5, "Stokers notes"), (6, "why C++"), (7, None), (8, "draculas")]
    q, b = spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(books, "book string")
    pairs = q.crossJoin(b)
    want = {(r.doc_id, r.book) for r in pairs.where(naming.named_in(pairs.text, pairs.book)).collect()}
    assert {tuple(r) for r in M.books_named(q, b).collect()} == want and len(want) >= 6


def test_books_named_are_single_as_they_are_made(spark):
    """No aggregate over the rows of questions and books, whose number is a multiple of the questions'."""
    books = [("Emma — Ann Emma",), ("Emma — Jane Austen",), ("emma — X. AUSTEN",), ("Austen — Austen",), ("— Poe",), (None,), ("Emma — Jane Austen",)]
    asked = [(1, "Emma by Austen, emma"), (2, "austen"), (2, "Emma"), (3, "see — Poe"), (4, None)]
    found = M.books_named(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(books, "book string"))
    rows = sorted(tuple(r) for r in found.collect())
    four = [b for (b,) in books[:4]]
    assert rows[:-1] == sorted((k, b) for k in (1, 2) for b in four) and rows[-1] == (3, "— Poe")
    assert not re.search(r"Aggregate \[doc_id#\d+L?, book#", found._jdf.queryExecution().optimizedPlan().toString())


def test_books_in_window(spark):
    hits = spark.createDataFrame([(1, 1, "A Dracula — S"), (1, 2, "Dracula — S"), (1, 3, None), (2, 1, "Emma")], "query_id long, rank int, book string")
    expected = spark.createDataFrame([(1, "dracula"), (1, "Emma"), (2, "emma"), (3, "Emma")], "query_id long, title string")
    assert {tuple(r) for r in M.books_in_window(hits, expected).collect()} == {(1, "dracula", 1, True), (1, "Emma", None, False), (2, "emma", 1, True), (3, "Emma", None, False)}


def test_clues_and_mixed_intent(spark):
    cases = [
        ("how many books by Poe", "", ""), ("How  is it built", "", "how"), ("who wrote Why", "Why", ""), ("Do I have Why, and why does it end?", "Why", "why"), ("do I have Why", "Why", ""),
        ("do I have Why", "Other", "why"), ("Чому це так", "", "чому"), ("як багато книг", "", ""), ("anyhow", "", ""), (None, "x", ""), ("Summarise it", "", "summarise"), ("why Why", "", "why"),
    ]
    rows = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(cases)], "ask_id int, question string, title string")
    resolved = spark.createDataFrame([(i, 1 if t == "Why" else 2) for i, (_, t, _) in enumerate(cases)], "ask_id int, books int")
    got = {r.ask_id: (r.clue, r.mixed) for r in M.mixed_intent(rows, resolved).collect()}
    assert got == {i: (c, c != "") for i, (_, _, c) in enumerate(cases)}
