"""Sharding of documents into parts of nearly equal bytes: a minimax contiguous partition of atomic groups.

Groups are documents of equal text, and stay together; their order is that of a 64-bit hash of the text, so a shard is a
random part of the corpus. Groups larger than a fair share get shards of their own, the largest first, for no cut can
help them. For the others the smallest capacity is searched by bisection for which a greedy pass needs no more shards
than there are; then cuts are made as near to equal shares as that capacity allows.

The search runs over sums of groups by ranges of their hash, not over the groups. BINS ranges give the places of
some cuts exactly and, for those between, bounds: a greedy pass that cuts only at known places needs at least as many
shards, one that cuts anywhere inside a range at most as many. Ranges in which the two still differ are read again in
finer ranges, until all cuts are certain; so the result is that of a pass over all groups in order, while the driver
holds a few hundred thousand numbers at most and each round is one aggregation. Shards are found by comparing hashes
with the cuts, and slots by numbering a range partitioning, so that neither a shard nor a group of copies has to fit one
task.

Null text counts as empty and is of one group with it. A document's size is its text's bytes and OVERHEAD. Rows that
repeat a doc_id are documents each; ties in slots are broken by doc_id, size and checksum, beyond which rows are alike.
Texts whose hashes agree by chance stay together too. Very long texts are hashed whole. Other columns are ignored. An
empty table gives no rows; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, remove

OVERHEAD = 16
#: Ranges of hashes whose sums a round brings to the driver, about.
BINS = 1 << 16
HASH_BITS = 63


class Edges(NamedTuple):
    """Known places between groups: the bytes before each (ends[0] = 0) and the last hash before it; sure[i] tells
    that no group lies between places i and i + 1 but one."""

    ends: np.ndarray
    keys: np.ndarray
    sure: np.ndarray

    def before(self, at: int, low: bool) -> int:
        """The last place at or before `at` bytes: exact, or a bound from below (low) or above."""
        i = int(np.searchsorted(self.ends, at, side="right")) - 1
        return int(self.ends[i]) if low or i + 1 >= len(self.ends) or self.sure[i] else at

    def after(self, at: int, low: bool) -> int:
        """The first place at or after `at` bytes, or a bound of it."""
        i = int(np.searchsorted(self.ends, at, side="left"))
        return int(self.ends[i]) if not low or not i or self.sure[i - 1] or self.ends[i] == at else at


def fits(edges: Edges, capacity: int, shards: int, low: bool) -> bool:
    """Whether a greedy pass with cuts by before(low) covers all bytes in so many shards."""
    at, whole = 0, int(edges.ends[-1])
    for _ in range(shards):
        if at >= whole:
            return True
        at = max(at, edges.before(at + capacity, low))
    return at >= whole


def smallest(edges: Edges, shards: int, low: bool) -> int:
    """The least capacity that fits(), by bisection."""
    lo, hi = -(-int(edges.ends[-1]) // shards), int(edges.ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if fits(edges, mid, shards, low):
            hi = mid
        else:
            lo = mid + 1
    return lo


def chain(edges: Edges, shards: int, low: int, high: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The cuts after shards 1 to shards - 1, each as bounds (from, to) for capacities from low to high, and the intervals of
    bytes in which places were looked for.

    A cut is the last place that is neither past its equal share nor past what the capacity allows from the cut before,
    but not so early that the shards after it could not hold the rest. All steps grow with their arguments, so bounds
    carry through."""
    whole, asked = int(edges.ends[-1]), []
    least = [(whole, whole)] * (shards + 1)
    for j in range(shards - 1, 0, -1):
        lo, hi = max(least[j + 1][0] - high, 0), max(least[j + 1][1] - low, 0)
        asked.append((lo, hi))
        least[j] = (edges.after(lo, True), edges.after(hi, False))
    cuts, at = [], (0, 0)
    for j in range(1, shards):
        share = j * whole // shards
        reach = (at[0] + low, at[1] + high)
        wanted = [min(r, share) for r in reach]
        asked.append((wanted[0], wanted[1]))
        at = (max(least[j][0], edges.before(wanted[0], True)), max(least[j][1], edges.before(wanted[1], False)))
        cuts.append(at)
    return cuts, asked


def greedy(edges: Edges, shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """The intervals of bytes in which greedy passes with capacities from low to high look for places."""
    asked, at = [], (0, 0)
    for _ in range(shards):
        asked.append((at[0] + low, at[1] + high))
        at = (max(at[0], edges.before(asked[-1][0], True)), max(at[1], edges.before(asked[-1][1], False)))
    return asked


def doubtful(edges: Edges, asked: list[tuple[int, int]]) -> np.ndarray:
    """Ranges between places, not sure yet, that an interval of bytes touches."""
    found = np.zeros(len(edges.sure), dtype=bool)
    for lo, hi in asked:
        first = max(int(np.searchsorted(edges.ends, lo, side="right")) - 1, 0)
        last = min(int(np.searchsorted(edges.ends, hi, side="left")), len(edges.sure))
        found[first:last] = True
    return np.flatnonzero(found & ~edges.sure)


#: Sums by ranges: (bits, wanted, finer) -> rows (range, bytes, groups, last) in the order of ranges, where a range is
#: hash >> finer, of the groups whose hash >> bits is wanted (None: of all).
Sums = Callable[[int, list[int] | None, int], list[tuple[int, int, int, int]]]


def sums_of(groups: DataFrame) -> Sums:
    """Sums over a table of groups (u, bytes)."""

    def read(bits: int, wanted: list[int] | None, finer: int) -> list[tuple[int, int, int, int]]:
        some = groups
        if wanted is not None:  # the ranges still in doubt, 2 * BINS at most
            ranges = groups.sparkSession.createDataFrame([(w,) for w in wanted], "w long")
            some = groups.join(F.broadcast(ranges), F.shiftright("u", bits) == F.col("w"), "left_semi")
        found = some.groupBy(F.shiftright("u", finer).alias("r")).agg(F.sum("bytes"), F.count("*"), F.max("u"))
        return sorted(tuple(r) for r in found.collect())

    return read


def cut_keys(sums: Sums, count: int, shards: int, bins: int = BINS) -> tuple[list[int], int]:
    """For count groups the last hash of each shard but the last (-1: the shard is empty, as are those before it), and the
    capacity: the least possible size of the largest shard when groups are cut in the order of their hashes."""
    width = bins.bit_length() - 1
    bits = 0 if count <= bins else HASH_BITS - width
    rows = sums(HASH_BITS, None, bits)
    #: the ranges between places: first bytes, groups, last hash, and how many bits of the hash lie within
    table = [(size, n, last, bits) for _, size, n, last in rows]
    while True:
        size, n, last, within = (np.array(x, dtype=np.int64) for x in zip(*table))
        edges = Edges(np.concatenate(([0], np.cumsum(size))), np.concatenate(([-1], last)), n == 1)
        high, low = smallest(edges, shards, True), smallest(edges, shards, False)
        cuts, asked = chain(edges, shards, low, high)
        if low == high and all(a == b for a, b in cuts):
            return [int(edges.keys[np.searchsorted(edges.ends, a)]) for a, _ in cuts], high
        unsure = doubtful(edges, asked + (greedy(edges, shards, low, high) if low < high else []))
        for bits in sorted(set(within[unsure].tolist())):
            of = unsure[within[unsure] == bits]
            split = min(bits, max(1, width - len(of).bit_length()))
            finer = 0 if int(n[of].sum()) <= bins else bits - split
            parts: dict[int, list] = {}
            for r, s, k, u in sums(bits, [int(x) >> bits for x in last[of]], finer):
                parts.setdefault(r >> (bits - finer), []).append((s, k, u, finer))
            for i in of.tolist():
                table[i] = parts[int(last[i]) >> bits]
        table = [x for t in table for x in (t if isinstance(t, list) else [t])]


def own_shards(largest: list[tuple[int, int]], whole: int, shards: int) -> list[int]:
    """Of the largest groups (hash, bytes), by falling size, the hashes of those above a fair share of what is left."""
    own = []
    for u, size in largest:
        if size * (shards - len(own)) <= whole:
            break
        own.append(u)
        whole -= size
    return own


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """Per row: doc_id, size, text_crc32 (unsigned), shard (from 0) and slot (its place there, from 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("u")
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("u").agg(F.sum("size").alias("bytes")), "shard-groups")
    whole, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    largest = [tuple(r) for r in groups.orderBy(F.desc("bytes"), "u").limit(shards).collect()]
    own = own_shards(largest, whole or 0, shards)
    place = F.lit(len(own))
    if count > len(own):
        others = groups.where(~F.col("u").isin(own)) if own else groups
        keys, _ = cut_keys(sums_of(others), count - len(own), shards - len(own), bins)
        for k in keys:
            place = place + (F.col("u") > k).cast("int")
    for i, u in enumerate(own):
        place = F.when(F.col("u") == u, i).otherwise(place)
    placed = numbered(rows.withColumn("shard", place.cast("int")), "shard", ["u", "doc_id", "size", "text_crc32"], "shard-order")
    remove(groups)
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("_i").alias("slot"))


def by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """shard() under the law of nearly equal bytes; adding a shard may move any row, so grown_shard is null."""
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
