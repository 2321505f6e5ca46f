import random

from pyspark.sql import functions as F

from lectern.operators import excerpts as X
from lectern.sources import epub, tables


def in_turn(chapters, each, total):
    parts, spent = [], 0
    for title, body in chapters:
        text = (body or "")[:each].strip()
        if text and spent + len(text) <= total:
            parts.append(f"### {title}\n{text}")
            spent += len(text)
    return len(parts), "\n\n".join(parts)


def test_as_taken_in_turn(spark):
    rng = random.Random(3)
    books = {}
    for b in [*range(30), None]:
        book = None if b is None else f"b{b}" if b else ""
        books[book] = [(f"t{n}", rng.choice([None, "", "  ", " x ", "ö" * rng.randint(1, 90)])) for n in range(rng.randint(1, 60))]
    # one with many chapters, more than an Arrow batch has
    books["long"] = [(f"t{n}", "y" * (1 + n % 7)) for n in range(25_000)]
    rows = [(k, n, t, x) for k, v in books.items() for n, (t, x) in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, n int, title string, body string").withColumn("spent", F.lit(1))
    got = {r.book: (r.chapters_read, r.excerpts) for r in X.excerpts(df, 40, 300).collect()}
    assert got == {k: w for k, v in books.items() if (w := in_turn(v, 40, 300))[0]}
    assert X.excerpts(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, "t", "xx")] * 4 + [("a", 1, "s", "y")], "book string, n int, title string, body string")
    assert [tuple(r) for r in X.openings(df, 10, 6).collect()] == [("a", 1, "s", "y"), ("a", 1, "t", "xx"), ("a", 1, "t", "xx")]


def test_refused_files_are_named(spark, tmp_path, monkeypatch):
    (tmp_path / "good.txt").write_text("A title\n\ntext")
    (tmp_path / "blank.md").write_text("  ")
    (tmp_path / "empty.txt").write_bytes(b"")  # Spark's file sources pass over it
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    got = {r.path.rsplit("/", 1)[1]: r.problem for r in tables.refused_books(spark, str(tmp_path)).collect()}
    assert got == {"blank.md": "holds nothing", "latin.txt": "not UTF-8"}
    assert tables.read_books(spark, str(tmp_path)).count() == 1
    monkeypatch.setattr(epub, "MOST_TOTAL", 10)
    (tmp_path / "large.epub").write_bytes(b"x" * 11)
    assert [(r.path.rsplit("/", 1)[1], r.section, r.problem) for r in epub.read_epubs(spark, str(tmp_path)).collect()] == [("large.epub", None, "larger than 10 bytes")]
