"""Token counts as delta-maintained rollups.

A batch is a table of signed rows: inserts (+1), deletes (-1), and revisions as a delete of the old count and an
insert of the new one. It is summed by source, language and tokenizer version, written to a folder of its own, and
committed by the exclusive creation of a marker file of its id, which names the folder. A batch that is committed
already is left alone, so redelivered or retried batches change nothing; a batch whose writing was cut off has no
marker (or a torn one, which counts as none) and adds nothing. Totals are the sums over committed batches: additive, so
order does not matter, and rows of documents are never read again.

compact() writes the totals so far as a snapshot, with the ids that it holds in a table beside, and publishes it by the
exclusive creation of its numbered marker; only then are the batches and snapshots that it replaces deleted. A batch
that a snapshot holds is never counted beside it, so a crash between any two steps changes no total, and ids stay known.

Null source or language is a group of its own. Null text has no tokens, but counts as a document. Repeated rows count
each. Very long texts are counted whole. Counts sum partially in each task before any shuffle, so a hot source costs
nothing extra. An empty batch commits and adds nothing. Extra columns are ignored, but for `sign`, which multiplies.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop, new_path
from .packing import ByteBPE

KEYS = ["source", "lang", "tokenizer"]
_ROLLUP = "source string, lang string, tokenizer string, docs long, tokens long"
_ID = re.compile(r"[A-Za-z0-9_-]{1,200}")


def byte_bpe() -> Callable[[str], int]:
    encode = ByteBPE()
    return lambda text: len(encode(text))


def white_space_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))


def letter_words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


#: Tokenizer versions that are column functions, and those that make, on the executor, a function from a text to its count.
COLUMNS: dict[str, Callable[[Column], Column]] = {"words@1": white_space_words, "words@2": letter_words}
TOKENIZERS: dict[str, Callable[[], Callable[[str], int]]] = {"byte_bpe_50k@1": byte_bpe}


def counted(rows: DataFrame, signs: dict[str, int], text_col: str = "text") -> DataFrame:
    """Signed sums of rows (source, lang, text) for tokenizer versions with their signs; a column `sign` of the rows
    multiplies."""
    sign = F.col("`sign`") if "sign" in rows.columns else F.lit(1)
    cols = rows.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), sign.cast("long").alias("sign"))
    parts = []
    if native := [n for n in signs if n in COLUMNS]:
        each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), (F.col("sign") * signs[n]).alias("docs"), (F.col("sign") * signs[n] * COLUMNS[n](F.col("text"))).cast("long").alias("tokens")) for n in native])
        parts.append(cols.select("source", "lang", F.explode(each).alias("x")).select("source", "lang", "x.*"))
    if made := {n: TOKENIZERS[n] for n in signs if n not in COLUMNS}:
        parts.append(cols.mapInArrow(_python_counts(made, signs), _ROLLUP))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _python_counts(made: dict, signs: dict[str, int]):
    """One row per group and Arrow batch."""

    def run(batches):
        count = {name: make() for name, make in made.items()}
        for batch in batches:
            docs, tokens = Counter(), Counter()
            source, lang, sign = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for s, g, t, k in zip(source, lang, batch.column(2), sign):
                text = t.as_py()
                for name, f in count.items():
                    docs[s, g, name] += k * signs[name]
                    tokens[s, g, name] += k * signs[name] * f(text)
            keys = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([c[k] for k in keys], pa.int64()) for c in (docs, tokens)],
                names=[*KEYS, "docs", "tokens"],
            )

    return run


class Rollup:
    """Committed batches under a folder that all machines share: commits/<id> (markers), data/<folder> (sums),
    snapshots/<number> (markers). What the driver holds is a line for each batch, never rows of documents."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, p = hadoop(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        fs, p = hadoop(self.spark, f"{self.path}/{name}")
        fs.delete(p, True)

    def _create(self, name: str, line: str) -> bool:
        """Create a file of a line, closed by the word `end`, if there is none of that name."""
        fs, p = hadoop(self.spark, f"{self.path}/{name}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(f"{line} end\n".encode()))
        out.close()
        return True

    def _lines(self, names: list[str]) -> list[list[str]]:
        """The words of marker files that are whole."""
        if not names:
            return []
        rows = self.spark.read.option("wholetext", True).text([f"{self.path}/{n}" for n in names]).collect()
        return [x[:-1] for r in rows if (x := r[0].split()) and x[-1] == "end"]

    def _state(self) -> tuple[dict[str, str], list[str], int, set[str]]:
        """Folders of the batches that no snapshot holds, by id; the snapshot's folder, its number, and its ids.

        Markers are listed before the snapshot: one that compact() deletes meanwhile is in the snapshot read after."""
        commits = {x[0]: x[1] for x in self._lines([f"commits/{n}" for n in self._names("commits")]) if len(x) == 2}
        for number in sorted((int(n) for n in self._names("snapshots") if n.isdigit()), reverse=True):
            if found := self._lines([f"snapshots/{number}"]):
                folder = found[0][0]
                held = {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.path}/data/{folder}/ids").collect()}
                return {k: v for k, v in commits.items() if k not in held}, [f"{folder}/sums"], number, held
        return commits, [], 0, set()

    def committed(self) -> set[str]:
        batches, _, _, held = self._state()
        return {*batches, *held}

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Commit signed sums (source, lang, tokenizer, docs, tokens) as a batch; False if it was committed already."""
        if not _ID.fullmatch(batch_id):
            raise ValueError("batch ids are up to 200 letters, digits, - and _")
        if batch_id in self.committed():
            return False
        folder = uuid.uuid4().hex
        deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{self.path}/data/{folder}")
        return self._commit(batch_id, folder)

    def _commit(self, batch_id: str, folder: str) -> bool:
        if not self._create(f"commits/{batch_id}", f"{batch_id} {folder}"):
            if self._lines([f"commits/{batch_id}"]):  # another writer was first
                self._delete(f"data/{folder}")
                return False
            self._delete(f"commits/{batch_id}")  # torn: its writer died
            return self._commit(batch_id, folder)
        return True

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _ROLLUP)
        read = self.spark.read.schema(_ROLLUP).parquet(*[f"{self.path}/data/{f}" for f in folders])
        return read.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups that have come to nothing are left out."""
        batches, snapshot, _, _ = self._state()
        return self._sums([*snapshot, *batches.values()])

    def compact(self) -> None:
        """One snapshot instead of the batches committed so far. May run beside apply(); of two at once, one wins."""
        batches, snapshot, number, held = self._state()
        if not batches:
            return
        folder = uuid.uuid4().hex
        self._sums([*snapshot, *batches.values()]).coalesce(1).write.parquet(f"{self.path}/data/{folder}/sums")
        self.spark.createDataFrame([(i,) for i in sorted({*batches, *held})], "id string").coalesce(1).write.parquet(f"{self.path}/data/{folder}/ids")
        if not self._create(f"snapshots/{number + 1}", folder):
            self._delete(f"data/{folder}")
            return
        for batch_id, old in batches.items():
            self._delete(f"commits/{batch_id}")
            self._delete(f"data/{old}")
        for name in snapshot:
            self._delete(f"snapshots/{number}")
            self._delete(f"data/{name.removesuffix('/sums')}")


#: Documents under so many characters are withdrawn by the query's third batch.
SHORT = 200


def maintained(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's run over whole documents: a batch inserts all under two tokenizers, one revises the words' counts to
    their tokenizer's next version, one deletes the documents under SHORT characters, and all are delivered again, before and
    after compaction. Returns the totals."""
    spark = docs.sparkSession
    rollup = Rollup(spark, path or new_path(spark, "rollup"))
    rows = docs.select("source", "lang", "text")
    short = rows.where(F.char_length("text") < SHORT)
    batches = [
        ("insert", counted(rows, {"byte_bpe_50k@1": 1, "words@1": 1})),
        ("revise", counted(rows, {"words@1": -1, "words@2": 1})),
        ("delete", counted(short.withColumn("sign", F.lit(-1)), {"byte_bpe_50k@1": 1, "words@2": 1})),
    ]
    for batch_id, deltas in batches:
        rollup.apply(batch_id, deltas)
    for batch_id, deltas in batches:
        rollup.apply(batch_id, deltas)
    rollup.compact()
    for batch_id, deltas in batches:
        rollup.apply(batch_id, deltas)
    return rollup.totals()
