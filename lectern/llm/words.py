"""Word hashes of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space. Memory is bounded by SLICE_BYTES of text besides eight bytes or so
for each word: a longer text is hashed piece by piece, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fixed odd multipliers of the word and sequence hashes.
P = 0x9E3779B97F4A7C15
A = 0xD6E8FEB86659FD93
#: Text bytes hashed at a time.
SLICE_BYTES = 500_000

_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_POW = _INV = np.zeros(0, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2^64, n at least."""
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(n, P), _powers(n, pow(P, -1, 2**64))
    return _POW, _INV


def range_sums(values: np.ndarray) -> np.ndarray:
    """Running sums of values weighted by powers, from which range_hashes() takes any range."""
    power, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the value sequences [begin, end): alike wherever the sequence stands."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


class Words(NamedTuple):
    hashes: np.ndarray
    #: where each word starts in the texts, joined by newlines with one more before and behind
    starts: np.ndarray
    #: whether it holds a digit
    digits: np.ndarray
    #: words of each text
    counts: np.ndarray
    #: where each text ends in the joined bytes
    ends: np.ndarray
    #: the joined bytes
    data: bytes


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    data = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(data, dtype=np.uint8)
    space = SPACE[raw]
    fold = LOWER if lower else _SAME
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(raw) - 1:
        hi = min(lo + SLICE_BYTES, len(raw) - 1)
        back = np.flatnonzero(space[lo + 1 : hi + 1])
        if len(back):
            hi = lo + 1 + int(back[-1])
        else:  # a word that is longer than a slice
            hi += 1 + int(np.argmax(space[hi + 1 :]))
        # both ends are white space
        buf, gaps = raw[lo : hi + 1], space[lo : hi + 1]
        edge = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        upto = np.zeros(len(buf) + 1, dtype=np.int32)
        np.cumsum(_DIGIT[buf], out=upto[1:])
        found.append((range_hashes(range_sums(BYTE[fold[buf]]), start, end), start + lo, upto[end] > upto[start]))
        lo = hi
    hashes, starts, digits = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return Words(hashes, starts, digits, np.diff(np.searchsorted(starts, ends), prepend=0), ends, data)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    grams = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        grams = grams * U(A) + words[k : k + len(grams)]
    return mix(grams)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash of a sequence that is shorter than a shingle."""
    h = U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = h * U(A) + w
    return mix(np.array([h], dtype=np.uint64))


def runs(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of texts with about SLICE_BYTES each, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= SLICE_BYTES or i + 1 == len(texts):
            yield [x or b"" for x in texts[begin : i + 1]]
            begin, size = i + 1, 0


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of a batch's rows with about SLICE_BYTES of text each (one row at least), and their texts; null is empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begin, done = 0, 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(size, done + SLICE_BYTES, side="right")), begin + 1)
        part = batch.slice(begin, end - begin)
        yield part, [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
        begin, done = end, int(size[end - 1])
