"""The streak fold of a run's steps: dry steps, and steps of which all evidence was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def advance(state: Column, fresh: Column, gone: Column) -> Column:
    """New evidence clears both counters; an all-dropped step counts as dry from the second in a row on; any other is
    dry and ends the dropped streak."""
    dropped = F.when(fresh, 0).when(gone, state["dropped"] + 1).otherwise(0).cast("long")
    dry = F.when(fresh, 0).when(gone & (state["dropped"] + 1 < 2), state["dry"]).otherwise(state["dry"] + 1).cast("long")
    return F.struct(dry.alias("dry"), dropped.alias("dropped"), F.greatest(state["peak"], dry).alias("peak"))


def streaks(events: DataFrame) -> DataFrame:
    """Per run (user_id): steps, dry, dropped and the peak of dry; advance() told by running sums, which spill.

    A step is dry unless it is fresh or the first of a row of dropped ones; dry steps count from the last fresh one on."""
    fresh = F.col("event_type").isin("purchase", "signup")
    steps = events.select("user_id", "ts", "event_id", fresh.cast("long").alias("fresh"), (~fresh & (F.col("event_type") == "error")).cast("long").alias("gone"))
    run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = steps.withColumns({"act": F.sum("fresh").over(run), "row": F.sum(1 - F.col("gone")).over(run), "first": F.col("gone") * (1 - F.coalesce(F.lag("gone").over(run), F.lit(0)))})
    within = lambda c: Window.partitionBy("user_id", c).orderBy("ts", "event_id")
    steps = steps.withColumn("dry", F.sum((1 - F.col("fresh")) * (1 - F.col("first"))).over(within("act"))).withColumn("dropped", F.sum("gone").over(within("row")))
    last = F.struct("ts", "event_id")
    return steps.groupBy("user_id").agg(F.count("*").alias("steps"), F.max_by("dry", last).alias("dry"), F.max_by("dropped", last).alias("dropped"), F.max("dry").alias("peak"))
