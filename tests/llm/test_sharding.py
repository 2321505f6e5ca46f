import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import sharding


def sums_in_memory(groups):
    def read(bits, wanted, finer):
        found = {}
        for u, size in sorted(groups):
            if wanted is None or u >> bits in set(wanted):
                s, n, _ = found.get(u >> finer, (0, 0, 0))
                found[u >> finer] = (s + size, n + 1, u)
        return [(r, *x) for r, x in sorted(found.items())]

    return read


def plain_cuts(groups, shards):
    """The same rule told plainly, over all groups in order."""
    ends = [0]
    for _, size in groups:
        ends.append(ends[-1] + size)
    whole = ends[-1]

    def needed(capacity):
        at, n = 0, 0
        while at < whole:
            reach = max(e for e in ends if e <= at + capacity)
            if reach == at:
                return 10**9
            at, n = reach, n + 1
        return n

    capacity = next(c for c in range(whole + 1) if c * shards >= whole and needed(c) <= shards)
    least = [whole] * (shards + 1)
    for j in range(shards - 1, 0, -1):
        least[j] = min(e for e in ends if e >= max(least[j + 1] - capacity, 0))
    cuts, at = [], 0
    for j in range(1, shards):
        at = max(least[j], max(e for e in ends if e <= min(at + capacity, j * whole // shards)))
        cuts.append(at)
    keys = [-1] + [u for u, _ in groups]
    return [keys[ends.index(c)] for c in cuts], capacity


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_those_of_a_pass_over_all_groups(seed):
    rng = random.Random(seed)
    n, shards, most = rng.choice([1, 2, 5, 30, 200]), rng.choice([1, 2, 3, 7, 40]), rng.choice([1, 4, 50])
    space = rng.choice([1 << 63, 1 << 12])
    groups = sorted((u, rng.randint(1, most)) for u in {rng.randrange(space) for _ in range(n)})
    if rng.random() < 0.3:
        groups[rng.randrange(len(groups))] = (groups[-1][0] + 1, 40 * most)
        groups.sort()
    want = plain_cuts(groups, shards)
    for bins in (2, 4, 16, 1 << 16):
        assert sharding.cut_keys(sums_in_memory(groups), len(groups), shards, bins) == want
    cuts, capacity = want
    sizes = np.bincount([sum(u > k for k in cuts) for u, _ in groups], weights=[s for _, s in groups], minlength=shards)
    assert sizes.max() <= capacity


def test_large_groups_get_their_own(spark):
    assert sharding.own_shards([(7, 50), (3, 30), (9, 5)], 100, 4) == [7, 3]
    assert sharding.own_shards([(7, 5), (3, 5)], 10, 40) == [7, 3]
    assert sharding.own_shards([(7, 5), (3, 5)], 10, 2) == []


def rows_of(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 300) + chr(rng.randint(97, 122)) for _ in range(900)] + ["copy " * 30] * 400 + ["", None, "é\n\0ß", "long " * 40_000]
    rows = [(i, t, "q", 3) for i, t in enumerate(texts)] + [(5, texts[5], "q", 3)] * 2 + [(None, "x", None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").repartition(7)


def test_shards(spark):
    rows, docs = rows_of(spark)
    for bins in (16, sharding.BINS):
        got = sharding.by_bytes(docs, 10) if bins == sharding.BINS else sharding.shard(docs, 10, bins=bins)
        got = got.collect()
        data = [(r[0], (r[1] or "").encode()) for r in rows]
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((-1 if i is None else i, len(t) + 16, zlib.crc32(t)) for i, t in data)
        slots, size = defaultdict(list), defaultdict(int)
        for r in got:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(10))
        where = defaultdict(set)
        by_id = {r.doc_id: r.shard for r in got}
        for i, t in data:
            where[t].add(by_id[i])
        assert all(len(x) == 1 for x in where.values())
        # the long text and the many copies have shards of their own; the rest is dealt evenly
        rest = sorted(size.values())[:-2]
        assert max(rest) - min(rest) < 700 and max(size.values()) == 200_016
    assert sharding.by_bytes(docs.limit(0)).count() == 0
    few = sharding.by_bytes(docs.where("doc_id < 3")).collect()
    assert len({r.shard for r in few}) == 3 and {r.law for r in few} == {"bytes"} and {r.grown_shard for r in few} == {None}


def test_rounds_over_a_table_are_those_over_rows(spark):
    rng = random.Random(1)
    groups = sorted((rng.randrange(1 << 63), rng.randint(17, 900)) for _ in range(5000))
    table = spark.createDataFrame(groups, "u long, bytes long").withColumn("bytes", F.col("bytes"))
    want = sharding.cut_keys(sums_in_memory(groups), len(groups), 12, 1 << 16)
    assert sharding.cut_keys(sharding.sums_of(table), len(groups), 12, 64) == want
