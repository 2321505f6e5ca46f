"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts: one on ordinary text, and one that
extends it by what marks toxic text (word starts far more frequent among toxic texts, each as long as most of its
occurrences agree). Each window of a text is compressed with both; its margin is what the toxic dictionary saves. A
text's score is a logistic function of its margins (largest, mean, mean excess over thresholds), calibrated on
sampled texts that the dictionaries did not see. Windows overlap, cover the whole text and are never joined, so
memory is bounded by one text.

Null texts count as empty; an empty text has one empty window. Without two labelled texts of each class there is
no model: every score is 0. Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, logistic
from .common import held_out
from .words import slices

WINDOW, STRIDE = 96, 80
ORDINARY_BYTES = 8192
#: The ordinary dictionary is trained on so many windows of a text at most, spread over all of it, and on so many in all.
TEXT_WINDOWS, TRAINING_WINDOWS = 20, 30_000
#: The bound of the sample that a model is fitted on, by label.
SAMPLE = {1: 2000, 0: 5000}
THRESHOLD = 0.5
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall


def windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE)]


def spread(items: list, most: int) -> list:
    return items if len(items) <= most else [items[i * (len(items) - 1) // (most - 1)] for i in range(most)]


def _starts(word: bytes) -> set[bytes]:
    spaced = b" " + word
    return {spaced[:k] for k in range(5, 12) if len(spaced) >= k} | {spaced + b" "}


def _frequency(texts: list[bytes], of: dict | None = None) -> Counter:
    """In how many texts each word start is (of those given)."""
    found: Counter = Counter()
    for t in texts:
        own = set().union(*map(_starts, set(_WORD(t)))) if t else set()
        found.update(own if of is None else own & of.keys())
    return found


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes], seed: int = 5) -> tuple[bytes, bytes]:
    """Raw dictionary content: ordinary, and the same with the marks of toxic text before it."""
    rng = random.Random(seed)
    lines = [w for t in ordinary for w in spread(windows(t), TEXT_WINDOWS)]
    rng.shuffle(lines)
    try:
        plain = zstandard.train_dictionary(ORDINARY_BYTES, lines[:TRAINING_WINDOWS]).as_bytes()[256:]
    except zstandard.ZstdError:  # too little text to train on
        plain = b"".join(lines)[-ORDINARY_BYTES:]
    least = max(3, 0.03 * len(toxic))
    # rarer starts are neither marks nor longer forms of marks
    in_toxic = {s: n for s, n in _frequency(toxic).items() if n >= 0.6 * least}
    in_ordinary = _frequency(ordinary, in_toxic)
    marks = {}
    for s, n in in_toxic.items():
        expected = in_ordinary[s] * len(toxic) / len(ordinary)
        if n >= least and n > 8 * (expected + 0.5 * len(toxic) / len(ordinary)) and n - expected > 5 * (1 + expected) ** 0.5:
            marks[s] = n
    stems = sorted((s for s in marks if not any(s[:k] in marks for k in range(5, len(s)))), key=lambda s: (marks[s], s))
    longer: dict[bytes, list[bytes]] = {s: [] for s in stems}
    for s in in_toxic:
        for k in range(5, len(s) + 1):
            if s[:k] in longer and in_toxic[s] >= 0.6 * marks[s[:k]]:
                longer[s[:k]].append(s)
    forms = dict.fromkeys(max(longer[s], key=lambda x: (len(x), x)) for s in stems)
    # marks come first, where they do not displace ordinary content from the match finder
    return plain, b"".join(forms) + plain


class Compressors:
    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        p = zstandard.ZstdCompressionParameters(
            window_log=15, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        made = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            made.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
        self.ordinary, self.toxic = made

    def features(self, text: bytes) -> list[float]:
        o, t = self.ordinary, self.toxic
        g = np.array([len(o(w)) - len(t(w)) for w in windows(text.lower())], dtype=float)
        return [g.max(), g.mean(), *(np.maximum(g - k, 0).mean() for k in (1, 2, 3, 5)), np.log1p(np.maximum(g - 3, 0).sum()), np.log1p(len(g))]


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> dict | None:
    rows = labelled.sample(docs, labels, F.col("toxic"), sample or SAMPLE, whole=True)
    texts = {v: [t.encode().lower() for y, t in rows if y == v] for v in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return None
    learn = {v: [t for i, t in enumerate(ts) if i % 3] or ts for v, ts in texts.items()}
    check = {v: ts[::3] for v, ts in texts.items()}
    ordinary, toxic = train_dictionaries(learn[1], learn[0])
    c = Compressors(ordinary, toxic)
    x = np.array([c.features(t) for v in (0, 1) for t in check[v]])
    y = np.array([float(v) for v in (0, 1) for _ in check[v]])
    # the sample's share of toxic rows is not the corpus's: the limits of SAMPLE are about in its ratio
    return {"ordinary": ordinary, "toxic": toxic, "fit": logistic.fit(x, y)}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: the id) with held_out, score and predicted."""
    names = keep or [id_col]
    kept = docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in names])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]) + ", score double"

    def run(batches):
        c = Compressors(model["ordinary"], model["toxic"]) if model else None
        for batch in batches:
            for part, texts in slices(batch, 0):
                s = logistic.apply(model["fit"], np.array([c.features(t) for t in texts])) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*names, "score"])

    scored = kept.mapInArrow(run, out)
    return scored.withColumns({"held_out": F.coalesce(held_out(F.col(id_col)), F.lit(False)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    return score(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted")
