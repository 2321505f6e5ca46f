"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every word feature (the word, its ending, its shape) has a sparse ternary index vector, drawn from its hash. A word's
context vector is the sum of its neighbours' index vectors over the sampled texts; words hash into TABLE rows, so the
table has a fixed size. A document is the mean of its words' vectors (context, ending and shape), with the spread of
word lengths, the share of repeated words and its length. A network of one hidden layer, trained on a bounded sample
of labelled rows, scores it; its temperature is fitted on sampled rows that it was not trained on, so scores are
calibrated probabilities of label 1.

Null and empty texts are scored as the zero vector. Without two labelled texts of each class every score is 1 (texts
are kept). Extra columns are ignored; repeated rows are scored alike. Texts are hashed in slices, so memory is
bounded by one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import held_out
from .words import BYTE, LOWER, SPACE, U, mix, range_hashes, range_sums, runs, slices

DIM, TABLE, HIDDEN = 32, 1 << 15, 48
#: The bound of the sample that a model is fitted on, by label.
SAMPLE = {0: 3000, 1: 6000}
THRESHOLD = 0.3
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: four entries of +1 or -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), dtype=np.float32)
    for _ in range(4):
        out[np.arange(rows), rng.integers(0, DIM, rows)] += rng.choice(np.array([-1, 1], dtype=np.float32), rows)
    return out


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in order: hash (A-Z lowered), ending's hash, shape (0-63), length; and each text's word count."""
    data = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    length = end - start
    low = BYTE[LOWER[raw]]
    word = range_hashes(range_sums(low), start, end)
    last = [low[np.maximum(end - k, start)] * (length >= k) for k in (1, 2, 3)]
    ending = mix(last[0] * U(3) + last[1] * U(0x632BE59BD9B4E019) + last[2] * U(0xD6E8FEB86659FD93))
    count = [np.append(0, np.cumsum(t[raw])) for t in (_UPPER, _DIGIT, _MARK)]
    upper, digit, mark = (c[end] - c[start] for c in count)
    shape = np.minimum(upper, 2) + 3 * (digit > 0) + 6 * np.minimum(mark, 3) + 24 * (upper * 2 > length)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))) + 1
    return word, ending, shape.astype(np.int64), length, np.diff(np.searchsorted(start, ends), prepend=0)


def train_vectors(texts: list[bytes], window: int = 2) -> np.ndarray:
    """Context vectors of the hashed words: summed index vectors of neighbours, as unit vectors."""
    index = index_vectors(TABLE, 11)
    table = np.zeros((TABLE, DIM), dtype=np.float32)
    for part in runs(texts):
        word, _, _, _, counts = word_features(part)
        row, owner = (word % U(TABLE)).astype(np.int64), np.repeat(np.arange(len(counts)), counts)
        for gap in range(1, window + 1):
            same = owner[gap:] == owner[:-gap]
            a, b = row[:-gap][same], row[gap:][same]
            np.add.at(table, a, index[b])
            np.add.at(table, b, index[a])
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.maximum(norm, 1e-6)


def _mean_rows(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if len(rows) > len(table):  # long texts by counts
        return np.bincount(rows, minlength=len(table)) @ table / len(rows)
    return table[rows].mean(0)


def pooled(texts: list[bytes | None], vectors: np.ndarray) -> np.ndarray:
    """Feature rows of the texts."""
    endings = index_vectors(4096, 12)
    out = []
    for part in runs(texts):
        word, ending, shape, length, counts = word_features(part)
        n = len(part)
        sums = np.zeros((n, 2 * DIM + 48 + 6), dtype=np.float64)
        at = np.append(0, np.cumsum(counts))
        for i in range(n):  # one text at a time: its gathered vectors are the largest array
            lo, hi = at[i], at[i + 1]
            if lo == hi:
                continue
            k = hi - lo
            w = word[lo:hi]
            sums[i, :DIM] = _mean_rows(vectors, (w % U(TABLE)).astype(np.int64))
            sums[i, DIM : 2 * DIM] = _mean_rows(endings, (ending[lo:hi] % U(4096)).astype(np.int64))
            sums[i, 2 * DIM : 2 * DIM + 48] = np.bincount(np.minimum(shape[lo:hi], 47), minlength=48) / k
            s = np.sort(w)
            repeated = 1 - (1 + np.count_nonzero(s[1:] != s[:-1])) / k
            lengths = length[lo:hi]
            sums[i, 2 * DIM + 48 :] = repeated, repeated * repeated, np.log1p(k) / 10, lengths.mean() / 10, lengths.std() / 10, lengths.max() / 50
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIM + 48 + 6))


def _forward(m: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - m["mean"]) / m["scale"]) @ m["w1"] + m["b1"]) @ m["w2"] + m["b2"]


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3) -> dict:
    """Adam on the logistic loss; the temperature by a search on the rows left out of training."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    m = {"mean": x[used].mean(0), "scale": x[used].std(0) + 1e-3}
    m |= {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(m[k]) for k in names} for _ in range(2))
    z, t, step = (x - m["mean"]) / m["scale"], y.astype(float), 0
    for epoch in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 128):
            b = used[i : i + 128]
            h = np.tanh(z[b] @ m["w1"] + m["b1"])
            p = 1 / (1 + np.exp(-np.clip(h @ m["w2"] + m["b2"], -30, 30)))
            d = (p - t[b]) / len(b)
            back = np.outer(d, m["w2"]) * (1 - h * h)
            g = {"w1": z[b].T @ back + 1e-4 * m["w1"], "b1": back.sum(0), "w2": h.T @ d + 1e-4 * m["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                m[k] = m[k] - 0.003 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    logit, want = _forward(m, x[held]), t[held]
    loss = lambda temp: np.logaddexp(0, -(2 * want - 1) * logit / temp).mean()
    m["temperature"] = min(np.geomspace(0.2, 10, 60), key=loss)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> dict | None:
    rows = labelled.sample(docs, labels, F.col("quality"), sample or SAMPLE)
    y = np.array([v for v, _ in rows])
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    texts = [t.encode() for _, t in rows]
    vectors = train_vectors(texts)
    return {"vectors": vectors, "net": fit(pooled(texts, vectors), y)}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    # the model's size is fixed: TABLE x DIM floats and the network
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, texts in slices(batch):
                s = 1 / (1 + np.exp(-np.clip(_forward(m["net"], pooled(texts, m["vectors"])) / m["net"]["temperature"], -30, 30))) if m else np.ones(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    return score(docs, train(docs, labels))
