"""An index that follows its documents against one built anew."""

import random
import re

import pytest

from lectern.operators import retrieval as R
from lectern.operators import segments as S

WORDS = [f"w{i}" for i in range(60)]


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def ranks(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in df.collect())


def test_changes_rank_like_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LEAST", 8)
    rng, docs = random.Random(1), {}
    queries = spark.createDataFrame([(i, " ".join(rng.sample(WORDS, 4))) for i in range(8)] + [(90, None), (91, "unheard")], "query_id long, text string")
    index = S.SegmentedIndex(spark, f"file://{tmp_path}/i")
    assert not index.exists() and ranks(index.search(queries)) == []
    merged = 0
    for step in range(5):
        new = {rng.randrange(40): rng.choice([text(rng), text(rng), None, ""]) for _ in range(rng.choice([1, 6, 12]))}
        gone = [i for i in range(40) if rng.random() < 0.15 and i not in new]
        before = {s: None for s, *_ in index.segments()}
        if step == 3:
            index.prune(spark.createDataFrame([(i,) for i in range(20)], "doc_id long"))
            docs = {i: t for i, t in docs.items() if i >= 20}
        else:
            index.upsert(frame(spark, new), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            docs = {i: t for i, t in docs.items() if i not in gone} | new
        assert set(before) <= {s for s, *_ in index.segments()}  # nothing that was written is written again
        if step % 3 == 2:
            merged += index.merge()
            assert index.recover() == []
        if step in (1, 4):
            want = R.bm25(queries, R.build_index(frame(spark, {i: t or "" for i, t in docs.items()}), f"file://{tmp_path}/whole{step}"))
            assert ranks(index.search(queries)) == ranks(want)
            assert sorted(r.doc_id for r in index.documents().collect()) == sorted(docs)
    assert merged


def test_a_cut_off_change_changes_nothing(spark, tmp_path, monkeypatch):
    index = S.SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.upsert(frame(spark, {1: "a b", 2: "b c"}))
    queries = spark.createDataFrame([(1, "b")], "query_id long, text string")
    want, kept = ranks(index.search(queries)), index.segments()

    def cut(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(index.store, "replace", cut)
        with pytest.raises(RuntimeError):
            index.upsert(frame(spark, {2: "x", 3: "b"}))
    assert ranks(index.search(queries)) == want and index.segments() == kept
    assert len(index.recover()) == 1 and ranks(index.search(queries)) == want
    rows = spark.createDataFrame([(5, "b"), (5, "b b"), (5, None)], "doc_id long, text string")
    index.upsert(rows)
    assert {r.doc_id: r.dl for r in index.documents().collect()} == {1: 2, 2: 2, 5: 2}


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    frame(spark, {1: "a b", 2: "b c"}).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    first = S.index_of(docs, f"file://{tmp_path}")
    assert S.index_of(docs, f"file://{tmp_path}").segments() == first.segments() and len(first.segments()) == 1
    assert S.index_of(docs.where("doc_id = 1"), f"file://{tmp_path}", "one").root != first.root
    frame(spark, {3: "z"}).write.mode("append").parquet(f"{tmp_path}/d")
    assert S.index_of(spark.read.parquet(f"{tmp_path}/d"), f"file://{tmp_path}").root != first.root
    plan = first.search(spark.createDataFrame([(1, "b")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert f"{tmp_path}/d" not in plan


def test_python_takes_long_texts_in_batches_of_bounded_bytes(spark):
    from pyspark.sql import functions as F

    from lectern.plans import all as plans

    plans.QUERIES["t_chunks"](spark, "/root/testdata/sf0.001")
    rows = F.pandas_udf(lambda s: s.map(lambda x: len(s)), "long")
    texts = spark.range(24, numPartitions=1).select(F.concat(F.repeat(F.lit("x"), 1 << 20), F.col("id").cast("string")).alias("text"))
    assert texts.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= 5


def test_sums_of_scores_stay_with_their_documents(spark, monkeypatch):
    """Postings are dealt by document before they meet the queries, so sums are not dealt anew; more terms than may be sent give the same."""
    terms = spark.createDataFrame([(q, t, 2) for q in range(3) for t in "abc"], "query_id long, term string, df long")
    held = spark.createDataFrame([(t, d, 1 + d % 3, 7) for d in range(30) for t in "abcd" if (d + ord(t)) % 2], "term string, doc_id long, tf long, dl int")
    sizes = spark.createDataFrame([(30, 7.0)], "n long, mean double")
    sent = R.scored(terms, held, sizes, 4)
    assert "hashpartitioning(query_id, doc_id" not in re.sub(r"#\d+L?", "", sent._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(R, "TERMS", 3)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, R.scored(terms, held, sizes, 4).collect())) and sent.count() == 12
