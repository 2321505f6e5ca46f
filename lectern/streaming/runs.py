"""The run-event log as a stream: windowed counts with late data, and each run's streaks as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as they arrive."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than `late` behind the newest are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def advance(state: tuple[int, int, int], fresh: bool, gone: bool) -> tuple[int, int, int]:
    """(dry, dropped, peak) after one step; see operators.streaks for the rule."""
    dry, dropped, peak = state
    if fresh:
        return 0, 0, peak
    dropped = dropped + 1 if gone else 0
    dry = dry if gone and dropped < 2 else dry + 1
    return dry, dropped, max(peak, dry)


def streaks(events: DataFrame) -> DataFrame:
    """(user_id, steps, dry, dropped, peak) of each run after every micro-batch that touches it; three counters a run
    are kept. Events of a batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        steps, *now = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            now = advance(tuple(now), kind in ("purchase", "signup"), kind == "error")
            steps += 1
        state.update((steps, *now))
        yield pd.DataFrame([(key[0], steps, *now)], columns=["user_id", "steps", "dry", "dropped", "peak"])

    out = "user_id long, steps long, dry long, dropped long, peak long"
    return events.groupBy("user_id").applyInPandasWithState(step, out, "steps long, dry long, dropped long, peak long", "update", "NoTimeout")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream's rows to Parquet, each micro-batch once."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
