"""Cards of books are shown once a run: which hits of a step are withheld.

All of it is joins and windows over hits, so runs are worked on side by side and no run's state is carried by a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .naming import REFUSALS_SHOWN, names_book

#: Fixed value: characters of a card's text that tell it from others.
KEY_CHARS = 2500


def withheld(hits: DataFrame, runs: DataFrame, refusals: DataFrame, most: int = REFUSALS_SHOWN) -> DataFrame:
    """Hits (hit_id, run, step, card, book, section, text) with withheld: whether a card that an earlier step of the run showed
    is left out of this one.

    Book text is never withheld. A run (run, chosen, asked_step) that was asked back chose a book: what steps up to
    asked_step showed of it counts no more from then on. Books of the last `most` refused quotes (run, step, ord, book:
    as written, a key or a title) before a step are exempt there. A step that would show nothing withholds nothing. Null
    books, sections and texts are values like others."""
    chosen = hits.join(runs.select("run", "chosen", "asked_step"), "run", "left")
    later = F.coalesce((F.col("book") == F.col("chosen")) & (F.col("step") > F.col("asked_step")), F.lit(False))
    same = Window.partitionBy("run", "card", "book", "section", F.left(F.col("text"), F.lit(KEY_CHARS)), later)
    seen = chosen.withColumn("_seen", F.col("card") & (F.min("step").over(same) < F.col("step"))).drop("chosen", "asked_step")
    # refusals are numbered in their run, and a step sees those that end before it
    turns = refusals.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("step", "ord")))
    steps = seen.where("_seen").select("run", "step").distinct().alias("s")
    ended = steps.select("run", "step", F.lit(None).cast("long").alias("_n")).union(turns.select("run", "step", F.col("_n").cast("long")))
    before = F.max("_n").over(Window.partitionBy("run").orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    last = ended.withColumn("_upto", before).where("_n is null and _upto is not null").select("run", "step", "_upto")
    named = turns.select("run", F.col("book").alias("_named"), "_n")
    candidates = seen.where("_seen").join(last, ["run", "step"]).join(named, "run").where(f"_n <= _upto and _n > _upto - {most}")
    exempt = candidates.where(names_book(F.col("_named"), F.col("book"))).select("hit_id").distinct().withColumn("_exempt", F.lit(True))
    judged = seen.join(exempt, "hit_id", "left").withColumn("_out", F.col("_seen") & F.col("_exempt").isNull())
    floor = F.min("_out").over(Window.partitionBy("run", "step"))
    return judged.withColumn("withheld", F.col("_out") & ~floor).drop("_seen", "_exempt", "_out")
