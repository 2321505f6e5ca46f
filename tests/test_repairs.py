"""Cases that larger tables hold and the small ones do not."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.operators import mentions as M
from lectern.operators import retrieval as R
from lectern.operators import segment as S
from lectern.operators import windows as W
from lectern.plans import segmentation


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_sentences_lose_spaces_and_no_digits_of_their_place(spark):
    text = "Zero.  1 is one\n. 2 is two"
    assert column(spark, [" 0 hours.\n1 day is 1. 2 more  "], X.sentences) == [["0 hours.", "1 day is 1.", "2 more"]]
    assert column(spark, [text], X.placed_chars) == [len("Zero.") + len("1 is one .") + len("2 is two")]


def test_a_window_of_a_quote_shows_it_where_its_words_stand_denser_elsewhere():
    quote = "the lamp went out and the keeper slept"
    text = "filler words here. " * 100 + quote + ". " + "other words there. " * 100 + "out keeper slept went lamp and the the the " * 6 + "more of it. " * 100
    assert quote not in W.around(text, quote, 700).text
    shown = W.around(text, quote, 700, verbatim=True)
    assert quote in shown.text and len(shown.text) <= 700
    assert W.around(text, "keeper of the lamp", 700, verbatim=True) == W.around(text, "keeper of the lamp", 700)


def test_normalize_keeps_marks_in_and_before_numbers_only(spark):
    got = column(spark, ["1.2,3-4–5 x-6 -7 (−8) a.b 9. _-1_2", "\x1f-1\u2028.2 .3", "½-4 ٣.٣"], X.normalize)
    assert got == ["1.2.3-4-5 x 6 -7 -8 a b 9 -1 2", "-1 2 3", "1 2-4 ٣.٣"]


def test_nearest_vectors_over_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "PART", 30)
    monkeypatch.setattr(R, "ROWS", 8)
    random = np.random.default_rng(5)
    rows = [[float(x) for x in np.float32(v)] for v in random.normal(size=(120, 6))]
    rows += [rows[0], rows[0], rows[3], [x + 1e-7 for x in rows[3]]]  # ties, and nearly so
    vectors = spark.createDataFrame(list(enumerate(rows)), "doc_id long, v array<float>")
    queries = vectors.where("doc_id % 6 = 0").selectExpr("doc_id as query_id", "v as q")
    for metric, down in ((R.squared_l2, False), (R.cosine, True)):
        pairs = vectors.crossJoin(queries).select("query_id", "doc_id", F.round(metric(F.col("q"), F.col("v")), 6).alias("score"))
        want = R.top(pairs, ["query_id"], [F.desc("score") if down else F.asc("score"), F.asc("doc_id")], 5)
        got = R.knn(queries, vectors, 5, metric, down)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
        # the pairs that all vectors and queries make are never rows
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_null_vectors_and_those_without_length(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "doc_id long, v array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<float>")
    assert [r["doc_id"] for r in R.knn(queries, vectors, 5, R.cosine, True).orderBy("rank").collect()] == [1, 4, 3]
    assert [r["doc_id"] for r in R.knn(queries, vectors, 5).orderBy("rank").collect()] == [1, 3, 4]


def test_entities_without_a_semicolon(spark):
    page = ["<article><h1>a &amp;&lt; b&amp</h1><p>x &#x27;y&#39; &copy z&</p></article>"]
    assert [b["text"] for b in column(spark, page, lambda c: B.blocks(c, "article", closed_entities=True))[0]] == ["a &< b&amp", "x 'y' &copy z&"]
    assert [b["text"] for b in column(spark, page, lambda c: B.blocks(c, "article"))[0]] == ["a &< b&", "x 'y' © z&"]


def test_lines_that_the_order_leaves_open_stand_as_in_the_table(spark, tmp_path):
    rows = [(d, "R", 1, 7, float(q)) for d in range(50) for q in ((5, 20) if d % 2 else (20, 5))]
    columns = "l_orderkey long, l_returnflag string, l_linenumber int, l_partkey long, l_quantity double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = segmentation.t_merge_toc(spark, str(tmp_path)).where("merged").collect()
    assert sorted(r["doc"] for r in got) == list(range(1, 50, 2))


def test_lines_without_a_number_or_part_come_last(spark, tmp_path):
    rows = [(1, "R", None, 7, 5.0), (1, "R", 2, 7, 20.0), (2, "R", 1, None, 5.0), (2, "R", 1, 3, 20.0), (3, "R", 1, 1, None), (3, "R", 2, 1, 5.0), (None, None, 1, 1, 5.0), (None, None, 2, 1, 5.0)]
    columns = "l_orderkey long, l_returnflag string, l_linenumber int, l_partkey long, l_quantity double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.execute(segmentation._MERGE).fetchall()
    assert sorted(map(str, map(tuple, segmentation.t_merge_toc(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_occurrences_of_one_title_apart(spark):
    texts = spark.createDataFrame([(1, "the the the THE the"), (2, "xthe athe at the at"), (3, "the the")], "doc_id long, text string")
    titles = spark.createDataFrame([("the the",), ("the at",)], "title string")
    got = sorted(map(tuple, M.mentions(texts, titles, longest=False, apart=True).collect()))
    assert got == [(1, "the the", 2, 0), (2, "the at", 1, 13), (3, "the the", 1, 0)]


def test_framed_texts_come_out_whole(spark, tmp_path):
    texts = ["", " ", "\n", " a b ", "\xa0a\u3000", "\u2003", "x\n*** END OF THIS FILE ***\ny", "*** START OF A\nx", "*** END OF A", "\n*** START OF B\n\n*** END OF B\nz", "e\n\n", None]
    spark.createDataFrame([(i, "en", "web", t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(f"SELECT doc_id, md5(trim(text)) AS body FROM '{tmp_path}/documents.parquet/*.parquet' ORDER BY doc_id").fetchall()
    assert list(map(tuple, segmentation.t_boilerplate(spark, str(tmp_path)).orderBy("doc_id").collect())) == want


def test_text_between_markers(spark):
    texts = ["head\n*** START OF X ***\n body \n*** END OF X ***\nlicence\n*** END OF", "*** START OF X\n*** END OF X", "*** START OF X\nto the end", "*** START OF X", " without ", "a\n*** END OF X"]
    assert column(spark, texts, S.between_markers) == ["body", "", "to the end", "", "without", "a\n*** END OF X"]
