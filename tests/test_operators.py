"""Rules that the test tables do not exercise."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chapters, evaluate, provenance, resolve, retrieval, segment
from lectern.sources import sinks, tables
from lectern.streaming import runs


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_keeps_numbers_apart(spark):
    got = column(spark, ["A_b 1.5, (-5) x-y 1–2\r\n“Q”", "wo​rd", "1.2.3", None], X.normalize)
    assert got == ["a b 1.5 -5 x y 1-2 q", "word", "1.2.3", None]


def test_keys(spark):
    assert column(spark, ["A — B — C", "Bare"], X.title_of) == ["A — B", "Bare"]
    assert column(spark, ["A — B — C", "Bare"], X.author_of) == ["C", ""]
    assert column(spark, ["Stand by Me by Ann", "x"], X.split_title_author) == ["Stand by Me — Ann", None]
    assert column(spark, ["!!"], X.slug)[0].startswith("book-")
    assert len(column(spark, ["y" * 600], X.shorten_label)[0]) == 500


def test_front_matter(spark):
    text = "---\ntitle: \"T\"\nauthor: A\n---\nbody"
    assert column(spark, [text], lambda c: X.front_matter_key(X.front_matter(c))) == ["T — A"]
    assert column(spark, [text, "plain"], X.without_front_matter) == ["body", "plain"]


def test_sentences_and_packing():
    assert segment.sentences('He said "no." Then left.\nEnd') == ['He said "no.', "Then left.", "End"]
    chunks = segment.pack(segment.sentences("Word " * 3000 + ". " + "Next one. " * 400))
    assert max(map(len, chunks)) <= segment.TARGET
    assert chunks[-1].startswith("Next one.")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .!?\n", max_size=400), max_size=8))
def test_packing_loses_no_sentence(parts):
    found = segment.sentences(" ".join(parts))
    chunks = segment.pack(found)
    assert all(len(c) <= segment.TARGET for c in chunks)
    assert all(any(s in c for c in chunks) for s in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A", "A (2)", "B", "A (3)"]), max_size=9))
def test_titles_are_unique(titles):
    out = segment.unique_titles(titles)
    assert len(set(out)) == len(out) == len(titles)


def test_chapters_and_markdown():
    text = "Lead\nCHAPTER I. One\n" + "x " * 150 + "\nCHAPTER II\n" + "y " * 150
    assert [t for t, _ in segment.chapters(text, preamble=True)] == ["Front matter", "CHAPTER I. One", "CHAPTER II"]
    assert [t for t, _ in segment.markdown_sections("# T\nintro\n## A\na\n## B\nb")] == ["Front matter", "A", "B"]
    merged = segment.merged_contents([("A", "x" * 300), ("B", "short"), ("B", "y" * 300)])
    assert [t for t, _ in merged] == ["A", "B"] and "short" in merged[0][1]


def test_html(spark):
    html = "<html><head><title> A  b </title></head><body><script>x</script><p>One <b>two</b></p><div>Three &amp; four</div><a class=x href=\"u\">l</a></body></html>"
    assert column(spark, [html], segment.html_paragraphs) == [["One two", "Three & four", "l"]]
    assert column(spark, [html], segment.html_title) == ["A b"]
    assert column(spark, [html], segment.html_links) == [["u"]]


def test_quotes(spark):
    quotes = spark.createDataFrame([(1, "The Cat, sat on", 10), (2, "five", 10), (3, "gone for good now", 10), (4, "end start", 11)], "quote_id long, quote string, cited long")
    passages = spark.createDataFrame([(10, "x the cat sat on it 15", "a", False), (11, "end\n[...]\nstart five", "a", False), (12, "", "b", True), (13, None, "b", True)], "passage_id long, text string, book string, card boolean")
    held = provenance.holders(quotes, passages)
    assert sorted(map(tuple, held.collect())) == [(1, 10), (2, 11)]
    got = {r["quote_id"]: (r["status"], r["gate"]) for r in provenance.verdicts(quotes, passages, held).collect()}
    assert got == {1: ("confirmed", "kept"), 2: ("unattributed", "short"), 3: ("broken", "not_found"), 4: ("broken", "not_found")}


def test_refusals(spark):
    long = "word " * 61
    assert column(spark, ["this is not available", f"not available {long}", "all fine", f"no evidence [{long}]"], evaluate.is_refusal) == [True, False, False, True]


def test_resolution(spark):
    held = spark.createDataFrame([("The Time Machine",), ("Dracula",), ("Émile",)], "name string")
    asked = spark.createDataFrame([("time machine",), ("Machine",), ("Dracula's Guest",), ("Dracul",), ("emile",), ("zzz",)], "asked string")
    got = {r["asked"]: (r["step"], r["matches"]) for r in resolve.resolve_names(asked, held).collect()}
    assert got["time machine"] == ("exact", "The Time Machine") and got["Machine"] == ("contained", "The Time Machine")
    assert got["Dracula's Guest"] != ("close", "Dracula") and got["Dracul"] == ("close", "Dracula") and got["emile"] == ("exact", "Émile") and got["zzz"][0] == "none"


def test_choice(spark):
    pick = lambda c: resolve.resolve_choice(c, ["Night", "Day"])
    assert column(spark, ["the second", "Night please", "not Night, Day", "either", None], pick) == ["Day", "Night", "Day", None, None]


def test_fusion_ties_keep_vector_order(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 7, 2), (1, 9, 3)], "query_id long, doc_id long, rank int")
    assert [r["doc_id"] for r in retrieval.rrf(a, b, 3).orderBy("rank").collect()] == [7, 8, 9]


def test_many_queries_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "doc_id long, v array<float>")
    queries = vectors.select((F.col("doc_id") * 10).alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, retrieval.knn(queries, vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 6)
    assert sorted(map(tuple, retrieval.knn(queries, vectors, 3).collect())) == whole


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "book_id long, note string")
    assert store.read("t") is None and store.replace("t", rows) == 2
    with pytest.raises(sinks.NoRows):
        store.replace("t", rows.where("false"))
    assert store.read("t").count() == 2
    (tmp_path / "t" / "v-crashed").mkdir()
    store.upsert("t", spark.createDataFrame([(1, "c"), (9, "b")], "book_id long, note string"), ["book_id", "note"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "c"), (9, "b")]
    assert "v-crashed" in store.recover("t") and store.read("t").count() == 2


def test_reading_folders(spark, tmp_path):
    books = tmp_path / "books"
    (books / ".hidden").mkdir(parents=True)
    (books / "A - B.txt").write_text("one\ntwo")
    (books / "c.md").write_text("# Title by Ann\ntext")
    (books / ".hidden" / "d.txt").write_text("x")
    (books / "bad.txt").write_bytes(b"\xff\xfe\xff")
    assert tables.book_files(spark, str(books)).count() == 3
    got = {r["path"].rsplit("/", 1)[1]: r["book"] for r in tables.read_books(spark, str(books)).collect() if ".hidden" not in r["path"]}
    assert got["c.md"] == "Title — Ann" and "bad.txt" not in got


def test_chapter_reads(spark):
    rows = spark.createDataFrame([("b", "n#full/10", "z"), ("b", "n#full/2", "y"), ("b", "bad", "x")], "book string, chunk_id string, text string")
    assert chapters.join_chunks(rows, ["book"], None).first()["body"] == "x\n[...]\ny\n[...]\nz"
    assert chapters.capped(rows, ["book"], 2).count() == 2


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    kinds = ["view", "error", "error", "purchase", "click", "error"]
    rows = [(i, t + dt.timedelta(minutes=i), 1, k, 1.0, "{}") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.where("event_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = runs.streaks(runs.read_events(spark, str(tmp_path / "in"), 10)).writeStream.outputMode("update").format("memory").queryName("streaks").start()
    q.processAllAvailable()
    q.stop()
    from lectern.operators import streaks

    last = spark.sql("select * from streaks").orderBy(F.desc("steps")).first()
    assert tuple(last) == tuple(streaks.streaks(df).first())
    q = runs.start(runs.windowed(runs.read_events(spark, str(tmp_path / "in")), length="2 minutes", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_spans():
    assert provenance.best_window("a cat and a dog. far away the cat", "cat dog", 20) == (2, 15)
    assert provenance.best_window("nothing", "cat", 20) is None
    assert provenance.quote_span("The Cat, sat\n[...]\non", "cat sat") == (4, 12)
    assert provenance.quote_span("The Cat, sat\n[...]\non", "sat on") is None


def test_cards_and_chains():
    card = "\n".join("- " + "x" * 500 for _ in range(6))
    assert [len(p) <= segment.CARD_TARGET for p in segment.card_pieces(card)] == [True] * 3
    heads = [(0, (1,)), (1, (7,)), (2, (1, 1)), (3, (2,)), (4, (9, 9)), (5, (3,))]
    assert segment.numbered_chain(heads) == [0, 2, 3, 5]
    assert segment.numbered_chain([]) == []


def test_blocks_and_refs(spark):
    assert column(spark, ["a </t> b"], lambda c: X.data_block("t", c)) == ["<t>\na ‹/t> b\n</t>"]
    assert column(spark, ["local:ab:x:y", "web:1"], lambda c: X.local_ref(c)["path"]) == ["x:y", None]


def test_epub(spark, tmp_path):
    import zipfile

    from lectern.sources import epub

    def book(name, **more):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            files = {
                "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
                "o/p.opf": '<package><metadata><title>T</title><creator>A</creator></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c" linear="no"/></spine></package>',
                "o/nav.xhtml": '<html><a href="a.xhtml#x">One</a></html>',
                "o/a.xhtml": "<html><body><p>first</p></body></html>",
                "o/b.xhtml": "<html><body><p>second</p></body></html>",
                "o/c.xhtml": "<html><body><p>aside</p></body></html>",
            } | more
            for k, v in files.items():
                z.writestr(k, v)

    book("good.epub")
    book("drm.epub", **{"META-INF/rights.xml": "<r/>"})
    (tmp_path / "bad.epub").write_bytes(b"no")
    got = sorted((r["path"].rsplit("/", 1)[1], r["section"], r["body"], r["problem"]) for r in epub.read_epubs(spark, str(tmp_path)).fillna("").collect())
    assert got == [("bad.epub", "", "", "not an archive"), ("drm.epub", "", "", "protected"), ("good.epub", "Notes", "aside", ""), ("good.epub", "One", "first\n\nsecond", "")]


def test_resolve_names_of_a_large_catalogue(spark, monkeypatch):
    """Blocks of names give what one list gives."""
    from lectern.operators import resolve

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 7)))
    titles = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(150)})
    asked = [t[:-1] + "x" for t in titles[::5]] + [f"{t} again" for t in titles[::9]] + [" ".join(word() for _ in range(3)) for _ in range(30)] + titles[:3] + ["zzzzzzzz", None]
    ask, held = spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(t,) for t in [*titles, None]], "name string")
    rows = lambda: sorted(map(tuple, resolve.resolve_names(ask, held).collect()), key=str)
    want = rows()
    assert {r[1] for r in want} >= {"exact", "close", "suggestion", "none"}
    monkeypatch.setattr(resolve, "MOST_NAMES", 20)
    monkeypatch.setattr(resolve, "ASKED", 7, raising=False)
    assert rows() == want


def test_ledger_life(spark, tmp_path):
    from lectern.operators import ledger as L
    from lectern.sources.sinks import Store

    books = L.Ledger(Store(spark, f"file://{tmp_path}"))
    assert books.rows().count() == 0 and L.missing(books.rows()).count() == 0
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert books.begin(made([("1", "Emma — Jane Austen", "local:a:emma.txt", "s1"), ("2", "Walden — H. D. Thoreau", "local:a:walden.txt", "s2")], "book_id string, key string, source_ref string, sha256 string"), "t1", "pack") == 2
    assert {r["title"] for r in L.missing(books.rows()).collect()} == {"Emma", "Walden"}
    books.commit(made([("1", 7)], "book_id string, rows long"), "t2")
    books.fail(made([("2", "no\n text " + "x" * 900)], "book_id string, error string"))
    got = {r["book_id"]: r for r in books.rows().collect()}
    assert (got["1"]["status"], got["1"]["rows"], got["1"]["author"], got["1"]["indexed_at"]) == ("indexed", 7, "Jane Austen", "t2")
    assert got["2"]["status"] == "failed" and got["2"]["error"].startswith("no text x") and len(got["2"]["error"]) == L.LONGEST_ERROR
    # begun again under a corrected key: what the batch leaves empty stays
    books.begin(made([("2", "Walden — Henry Thoreau", "", "")], "book_id string, key string, source_ref string, sha256 string"), "t3")
    again = books.rows().where("book_id = '2'").first()
    assert (again["key"], again["source_ref"], again["status"], again["error"]) == ("Walden — Henry Thoreau", "local:a:walden.txt", "requested", "")
    with pytest.raises(KeyError):
        books.commit(made([("9", 1)], "book_id string, rows long"), "t4")
    with pytest.raises(ValueError):
        books.put(made([("1", 1)], "book_id string, colour long"))
    assert books.backfill(made([("n1", "Emma — Jane Austen"), ("n2", "Dracula — Bram Stoker"), ("n2", "Dracula — Bram Stoker")], "note string, book string"), "t5") == 3
    assert books.rows().where("key like 'Dracula%'").first()["rows"] == 2


def test_ledger_resolve_in_order(spark):
    from lectern.operators import ledger as L

    held = L.with_fields(spark.createDataFrame([("1", "A", "local:x:a", "s1"), ("2", "B", "local:x:b", "s2")], "book_id string, key string, source_ref string, sha256 string"))
    rows = [(1, "A2", "local:x:a", ""), (2, "A", "local:x:q", ""), (3, "B", "", ""), (4, "B2", "local:x:b", ""), (5, "C", "local:x:c", "s2"), (6, "C", "local:x:d", "")]
    got = {r["ord"]: r for r in L.resolve(held, spark.createDataFrame(rows, "ord int, key string, source_ref string, sha256 string")).collect()}
    # 1 takes the file's slot before 2 answers to the old key; 3 has claimed B's slot before 4 asks for it
    assert [got[i]["matched_by"] for i in range(1, 7)] == ["source", "key", "key", "new", "new", "key"]
    assert got[1]["book_id"] == "1" and got[3]["book_id"] == "2" and got[5]["book_id"] == got[6]["book_id"] and got[5]["twin"] is None and got[4]["twin"] is None


def test_ledger_and_index_agree(spark):
    from lectern.operators import ledger as L

    held = L.with_fields(spark.createDataFrame([("1", "A", "indexed", 2)], "book_id string, key string, status string, rows long"))
    rows = spark.createDataFrame([("A", "1"), ("A", "1")], "book string, book_id string")
    assert L.check(held, rows, rows.select("book")).count() == 0


def test_index_of_nothing_and_streaks_match_the_fold(spark, tmp_path):
    from functools import reduce

    from lectern.operators import retrieval, streaks

    empty = retrieval.build_index(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/i")
    assert retrieval.bm25(spark.createDataFrame([(1, "word")], "query_id long, text string"), empty).count() == 0
    rng = random.Random(5)
    steps = [(u, i, i, rng.choice(["purchase", "error", "error", "view"])) for u in range(6) for i in range(rng.randrange(1, 40))]

    def fold(state, kind):
        dry, dropped, peak = state
        if kind == "purchase":
            dry, dropped = 0, 0
        elif kind == "error":
            dropped += 1
            dry += dropped >= 2
        else:
            dry, dropped = dry + 1, 0
        return dry, dropped, max(peak, dry)

    got = streaks.streaks(spark.createDataFrame(steps, "user_id int, ts int, event_id int, event_type string"))
    want = {u: reduce(fold, [k for x, _, _, k in steps if x == u], (0, 0, 0)) for u in {s[0] for s in steps}}
    assert {r["user_id"]: (r["dry"], r["dropped"], r["peak"]) for r in got.collect()} == want
