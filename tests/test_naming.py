"""Operators of names, headings and requests against plain Python on small cases."""

import re

from pyspark.sql import functions as F

from lectern.operators import naming as N


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_rows_for_names(spark):
    rows = spark.createDataFrame([(1, "Emma — Jane Austen"), (2, "Emma's Diary — A"), (3, "Emma"), (4, "A — B — C"), (5, None), (6, "Emma — Other"), (3, "Emma")], "id long, book string")
    asked = spark.createDataFrame([(1, "Emma"), (2, "Emma — Jane Austen"), (3, "A — B"), (4, "Em"), (5, None)], "ask_id long, name string")
    got = sorted((r.ask_id, r.id) for r in N.rows_for_names(rows, asked).collect())
    assert got == [(1, 3), (1, 3), (2, 1), (3, 4)]
    by_title = N.rows_for_names(rows.where("book <> 'Emma'"), asked.where("ask_id = 1"))
    assert sorted(r.id for r in by_title.collect()) == [1, 6]
    assert N.rows_for_names(rows.limit(0), asked).count() == 0
    plan = N.rows_for_names(rows, asked)._jdf.queryExecution().executedPlan().toString()
    assert not any("Join" in line and "[ask_id" in line for line in plan.splitlines())  # what is found is not joined again
    assert column(spark, [("Emma", "Emma — X"), ("Em", "Emma — X"), ("Emma — X", "Emma — X")], "w string, k string", N.names_book(F.col("w"), F.col("k"))) == [True, False, True]


def test_named_in(spark):
    rows = [("what is in it?", "It — King"), ("with him", "It — King"), ("did King say", "It — Stephen King"), ("a.b", "a.b — X"), ("axb", "a.b — X"), ("naïveté", "naïv — Y"), ("q\\Ex", "q\\Ex — Z"), (None, "It — K"), ("", "It")]
    assert column(spark, rows, "q string, b string", N.named_in(F.col("q"), F.col("b"))) == [True, False, True, True, False, False, True, None, False]


def test_searches(spark):
    rows = [("Ahab's leg?",), ("  ahab's   LEG ",), ("Straße ﬁn…",), ("«Ahab»",), ("?!",), ("",), (None,), ("a b",)]
    assert column(spark, rows, "q string", N.search_key(F.col("q"))) == ["ahab's leg", "ahab's leg", "strasse fin", "ahab", "", "", None, "a b"]
    assert column(spark, [(" __book__|a|b",), ("book",), (None,)], "q string", N.is_loop_marker(F.col("q"))) == [True, False, False]
    steps = spark.createDataFrame([(1, 1, "Whale?", None), (1, 2, "whale", ""), (1, 3, "whale", "M"), (1, 4, "__x__", ""), (2, 1, "whale", ""), (2, 2, None, ""), (2, 3, "?", "")], "run long, step long, query string, book string")
    assert sorted(map(tuple, N.new_searches(steps).collect())) == [(1, "whale", "", 1), (1, "whale", "M", 3), (2, "whale", "", 1)]
    assert column(spark, [("a", "b"), ("", "b"), (None, None)], "c string, f string", N.effective_book(F.col("c"), F.col("f"))) == ["a", "b", ""]


def test_choice_and_refusals(spark):
    evidence = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c")], "run long, book string")
    runs = spark.createDataFrame([(1, True, "a"), (2, True, None), (3, False, None)], "run long, asked boolean, chosen string")
    got = sorted((r.run, r.book, r.unresolved) for r in N.evidence_of_choice(evidence, runs).collect())
    assert got == [(1, "a", False), (2, "a", True), (2, "b", True), (3, "a", False), (4, "c", False)]
    refusals = spark.range(10).select((F.col("id") % 1).alias("run"), F.col("id").alias("step"))
    assert sorted(r.step for r in N.last_refusals(refusals).collect()) == [4, 5, 6, 7, 8, 9]


def test_headings(spark):
    pairs = [("7) Salt Marshes", "Salt marshes"), ("IX. Tides", "tides"), ("A Harbour", "Harbour"), ("Chapter 2.1 Logs", "logs"), ("B) Notes", "notes"), ("One", "Two")]
    assert column(spark, pairs, "a string, b string", N.same_heading(F.col("a"), F.col("b"))) == [True, True, False, True, True, False]
    assert column(spark, [(" A\n  b ]",)], "h string", N.heading_title(F.col("h"))) == ["A b"]
    rows = [("B", "S", "t"), ("B", "", "t"), ("B", None, "t")]
    assert column(spark, rows, "b string, s string, t string", N.embedding_text(F.col("b"), F.col("s"), F.col("t"))) == ["B — S\nt", "B\nt", "B\nt"]


def cut(sections, pattern, title):
    name, body = sections[-1]
    m = re.search(pattern, body or "", re.M)
    if not m or not body[m.end() :].strip():
        return sections, False
    back = (title, body[m.start() :].strip()) if title else (m.group().strip(), body[m.end() :].strip())
    return sections[:-1] + ([(name, body[: m.start()].strip())] if body[: m.start()].strip() else []) + [back], True


def test_back_matter(spark):
    books = {
        1: [("I", "NOTES\nin the first"), ("II", "text\n\nNOTES\n one two \nNOTES\nagain")],
        2: [("I", "text\nNOTES  \n ")], 3: [("I", "NOTES\nall of it")], 4: [("I", "no NOTES here\nNOTES and more")], 5: [("I", "")], 6: [("I", None)],
    }
    rows = [(b, n, t, x) for b, own in books.items() for n, (t, x) in enumerate(own)]
    table = spark.createDataFrame(rows, "book long, n long, title string, body string")
    for title in (None, "Back matter"):
        got = N.cut_back_matter(table, "^NOTES$", title).orderBy("book", "n").collect()
        for b, own in books.items():
            wanted, flag = cut(own, "^NOTES$", title)
            assert [(r.title, r.body) for r in got if r.book == b] == wanted
            assert {r["cut"] for r in got if r.book == b} == {flag}


def test_requests(spark):
    ops = ("count", "list", "has", "by_author")
    replies = ['{"catalog": {"op": "has", "title": " Emma "}}', '{"catalog": {"op": "has", "title": 3}}', '{"catalog": {"op": "by_author"}}', '{"catalog": {"op": "count"}}', '{"catalog": "count"}', '{"catalog": {"op": "drop"}}', "{}", "no json", None]
    got = column(spark, [(r,) for r in replies], "r string", N.catalogue_request(F.col("r"), ops))
    assert [tuple(g) if g else None for g in got] == [("has", "Emma", ""), None, None, ("count", "", ""), None, None, None, None, None]
    payload = F.try_parse_json(F.col("r"))
    flags = [('{"k": true}',), ('{"k": " Yes "}',), ('{"k": 1}',), ('{"k": "1"}',), ('{"k": false}',), ('{"k": [true]}',), ("[]",), (None,)]
    assert column(spark, flags, "r string", N.bool_field(payload, "k")) == [True, True, False, True, False, False, False, False]
    texts = [('{"k": "a"}',), ('{"k": "  "}',), ('{"k": 2}',), ('{"k": "c"}',)]
    assert column(spark, texts, "r string", N.str_field(payload, "k", ("a", "b"))) == ["a", None, None, None]
