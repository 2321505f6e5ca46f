"""Publishing a rebuilt table over a live one in stores that cannot rename a folder in one step, and finishing it after a kill.

A rebuild is written to a staging folder and then copied over the live one. Before the live folder is deleted, a marker
with the number of staged rows is written (to a side file, synced, renamed); it goes once the copy holds as many. So at
any moment one complete copy exists, and decide() tells from what is there which one that is."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .sinks import NoRows


class RecoveryError(RuntimeError):
    """No copy can be told to be complete, so none was deleted."""


class State(NamedTuple):
    """What is there of a table: whether a live folder is listed, is readable, and was ever committed; the same of the
    staged copy with its rows; whether there is a marker, and the rows that it names."""

    live: bool
    live_reads: bool
    live_committed: bool
    staging: bool
    staged_rows: int | None
    marker: bool
    marker_rows: int | None


# What is to be done.
NOTHING, FORGET, DISCARD, PROMOTE, REFUSE = "nothing", "forget the marker", "discard staging", "promote staging", "refuse"


def decide(s: State) -> str:
    """The step that leaves one complete table.

    A marker says that staging was complete: it is promoted whatever the live folder looks like, unless it no longer
    holds the rows named. Without one a readable live table is whole, and staging is a build that did not finish. A live
    folder that is not readable is a copy that was cut off if it was never committed; then staging is promoted. If it was
    committed, or staging is not readable, nothing can be told, and nothing is deleted."""
    if not s.staging:
        return FORGET if s.marker else NOTHING
    readable = s.staged_rows is not None
    if s.marker:
        return PROMOTE if readable and s.marker_rows in (None, s.staged_rows) else REFUSE
    if s.live and s.live_reads:
        return DISCARD
    if not readable or (s.live and s.live_committed):
        return REFUSE
    return PROMOTE


class Tables:
    """Tables that are Parquet folders under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _rows(self, folder: str) -> int | None:
        """Rows of a folder that can be read, else None."""
        try:
            return self.spark.read.parquet(f"{self.root}/{folder}").count()
        except (PySparkException, Py4JError):
            return None

    def _delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def _write_marker(self, name: str, rows: int) -> None:
        aside, at = self._at(f".publish-{name}.{uuid.uuid4().hex}"), self._at(f".publish-{name}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"rows": rows}).encode()))
        out.hsync()
        out.close()
        self._fs.delete(at, False)
        if not self._fs.rename(aside, at):
            raise OSError(f"{name}: the marker could not be written")

    def _marker(self, name: str) -> tuple[bool, int | None]:
        at = self._at(f".publish-{name}")
        if not self._fs.exists(at):
            return False, None
        stream = self._fs.open(at)
        try:
            rows = json.loads(bytes(stream.readAllBytes()))["rows"]
        except (ValueError, KeyError, TypeError):  # unreadable, but it says that a publish began
            rows = None
        finally:
            stream.close()
        return True, rows if isinstance(rows, int) else None

    def state(self, name: str) -> State:
        live, staging = self._fs.exists(self._at(name)), self._fs.exists(self._at(f"{name}.staging"))
        committed = live and self._fs.exists(self._at(f"{name}/_SUCCESS"))
        return State(live, live and self._rows(name) is not None, committed, staging, self._rows(f"{name}.staging") if staging else None, *self._marker(name))

    def readable(self, name: str) -> DataFrame | None:
        """The folder that holds the table's rows now: the staged copy while a publish of it is not finished."""
        step = decide(self.state(name))
        if step == REFUSE:
            raise RecoveryError(name)
        folder = f"{name}.staging" if step == PROMOTE else name
        return self.spark.read.parquet(f"{self.root}/{folder}") if self._fs.exists(self._at(folder)) else None

    def publish(self, name: str, rows: DataFrame) -> int:
        """Replace the table by rows; returns their number. An earlier publish that was cut off is finished first."""
        self.recover(name)
        rows.write.parquet(f"{self.root}/{name}.staging")
        n = self._rows(f"{name}.staging")
        if not n:
            self._delete(f"{name}.staging")
            raise NoRows(name)
        self._promote(name, n)
        return n

    def _promote(self, name: str, n: int) -> None:
        self._write_marker(name, n)
        self._delete(name)
        self.spark.read.parquet(f"{self.root}/{name}.staging").write.parquet(f"{self.root}/{name}")
        if self._rows(name) != n:
            self._delete(name)
            raise RecoveryError(f"{name}: the copy lacks rows; staging is kept")
        self._delete(f"{name}.staging")
        self._delete(f".publish-{name}")

    def recover(self, name: str) -> str:
        """Do what decide() says; returns it."""
        state = self.state(name)
        step = decide(state)
        if step == REFUSE:
            raise RecoveryError(f"{name}: {state}")
        if step == DISCARD:
            self._delete(f"{name}.staging")
        elif step == PROMOTE:
            self._promote(name, state.staged_rows)
        elif step == FORGET:
            self._delete(f".publish-{name}")
        return step
