"""The queries by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.tables import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Bytes of a batch (or one row) that a Python worker takes at a time, so that its memory does not follow the texts' lengths.
#: Spark reads the setting when a query runs, so it stays set for the session.
BATCH_BYTES = 4 << 20


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables that the text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def both(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL that both engines understand (oracle: DuckDB's text where it differs)."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE_SQL[name] = oracle or text
