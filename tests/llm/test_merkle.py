import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lectern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, i string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """The root, and for each leaf its siblings left and right, level by level."""
    nodes, paths = [(h, [k]) for k, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k, (_, under) in enumerate(run):
                for leaf in under:
                    paths[leaf].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [x for _, u in run for x in u]))
        nodes = above
    return nodes[0][0], paths


def plain(rows, fanout=3):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    trees = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        trees[r[3]].append((r[0], leaf(r, r[1]), leaf(r, r[1].replace("\n", "") if hit else r[1])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        own[s] = plain_tree([x[1] for x in trees[s]], fanout)
    root, above = plain_tree([own[s][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for (doc_id, h, found), path in zip(trees[s], own[s][1]):
            whole = path + above[k]
            for left, right in whole:
                found = sha(left + found + right)
            out.append((doc_id, h, own[s][0], root, sha("".join(a + b for a, b in whole)), found, found == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=0):
    rng = random.Random(seed)
    rows = [(i * 7 - 50, rng.choice(["a\nb", "", None, "é\n\n", "one line", "x" * 50_000]), rng.choice(["en", None]), rng.choice(sources), rng.choice([1, None, -3]), 5, "i") for i in range(n)]
    return rows


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (1, [None]), (3, ["a"]), (4, ["a"]), (5, ["a", "b"]), (200, ["a"] * 20 + ["b", "", None, "é", "Z", "~", "lone"]), (90, [f"s{k}" for k in range(40)])])
def test_manifest(spark, n, sources):
    rows = rows_of(n, sources)
    if n > 50:
        rows += [rows[3]] * 4 + [(rows[3][0], "other", *rows[3][2:]), (None, "t\n", "en", "b", 1, 5, "i"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in merkle.audited(docs).collect()), key=str)
    assert got == plain(rows)


def test_unchanged_rows_are_verified(spark):
    docs = spark.createDataFrame(rows_of(70, ["a", "a", "b"]), SCHEMA)
    got = merkle.manifest(docs).collect()
    assert all(r.verified and r.folded_root == r.root for r in got) and len({r.root for r in got}) == 1
    other = merkle.manifest(docs.where("doc_id <> -50")).first().root
    assert other != got[0].root


def test_wider_runs(spark):
    rows = rows_of(60, ["a", "a", "b"])
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=4).collect()
    assert {(r.doc_id, r.subroot, r.root) for r in got} == {(r[0], r[2], r[3]) for r in plain(rows, 4)} and all(r.verified for r in got)


def test_no_rows(spark):
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).count() == 0
