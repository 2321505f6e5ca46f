"""N-gram Jaccard join over whole documents, by token-combination prefixes.

A document's tokens are its distinct word 5-gram hashes. Two token sets with Jaccard similarity >= t share at
least ceil(t*|x|) tokens of x, so x can lose at most floor((1-t)*|x|) tokens towards any partner. All documents
order their tokens alike (document frequency, then hash); a prefix that still holds a usable signature after any
such loss must share one with every partner's prefix (prefix filtering). Tokens that occur in one set only come
first and yield no signature, rare tokens are signatures of their own, and frequent tokens are split by hash into
groups of which pairs are indexed: a group with c tokens in the prefix survives c-1 losses, so the prefix is
extended until the losses it survives exceed the bound. Most documents are settled by their unique tokens alone.

Nodes of the join are distinct token sets, so exact copies cost one row. In each signature bucket all nodes are
first verified against one pivot, links are contracted to components, and only node pairs of a bucket that lie
in different components are verified after that: groups of near copies never expand into all pairs, and no
link that could join two components is skipped. Each node has a few words of parity bits of its tokens; as bits that
differ bound from below by how many tokens two nodes differ, pairs too far apart do not leave a bucket's join.

Nulls, empty and word-less texts have an empty set and link with nothing (component = own id). Rows that repeat a
doc_id each give a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .components import components
from .words import A, P, U, mix, shingle_hashes, slices, whole_hash, words_of

#: Tokens a map task gathers before it writes one block per bucket.
FLUSH_TOKENS = 1_000_000
#: Tokens of a span on average, which are gathered at a time, and of all documents to a bucket of nodes; the number of
#: both follows the corpus.
SPAN_TOKENS = 3_000_000
#: Buckets of spans, a task each, where there are no more cores. Each has the ids of nearly all nodes once, so that with
#: many a token of a document would come with an id of its own.
TOKEN_BUCKETS = 64
#: Columns of 64 parity bits each that a node has.
PARITY = [f"x{i}" for i in range(8)]


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than width the whole sequence is one."""
    found = words_of(texts)
    grams = shingle_hashes(found.hashes, width)
    at = 0
    for count in found.counts.tolist():
        if count >= width:
            own = np.sort(grams[at : at + count - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif count:
            yield whole_hash(found.hashes[at : at + count])
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += count


def node_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _documents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for part, texts in slices(batch):
            yield part.column(0), list(shingle_sets(texts, width))


def _members(width: int):
    def run(batches):
        for ids, sets in _documents(batches, width):
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_key(s) if len(s) else None for s in sets], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "node"],
            )

    return run


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unplanes(data: bytes, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, n).T).view(dtype).reshape(n)


_ZSTD = None


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of the arrays, compressed."""
    global _ZSTD
    _ZSTD = _ZSTD or zstandard.ZstdCompressor(level=1)
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], dtype=np.int64).tobytes()
    return _ZSTD.compress(head + b"".join(map(_planes, arrays)))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * count, 8).tolist()
    at, out = 8 + 16 * count, []
    for n, size in zip(head[0::2], head[1::2]):
        out.append(_unplanes(data[at : at + n * size], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size], n))
        at += n * size
    return out


def _block(token: np.ndarray, owner: np.ndarray, *more: np.ndarray) -> bytes:
    """Entries sorted by token: gaps of the tokens, owners in as few bytes as they need, and what else goes with them."""
    return pack(np.diff(token, prepend=U(0)), owner.astype(np.uint16 if int(owner.max()) < 65536 else np.uint32), *more)


def _span_of(token: np.ndarray, bits: int, spans: int) -> np.ndarray:
    """Which of as many equal ranges a token of so many bits lies in."""
    return (((token >> U(bits - 32)) * U(spans)) >> U(32)).astype(np.int64)


def _token_blocks(width: int, bits: int, spans: int, buckets: int, percent: int):
    """Per flush of a map task and bucket (a run of spans): its nodes (span -1), and per span one block of (token, owner)
    entries sorted by token, with owners as places among those nodes."""

    def flush(tokens, nodes, sizes):
        ordered = np.argsort(np.array(nodes, dtype=np.uint64))
        node = np.array(nodes, dtype=np.uint64)[ordered]
        token = np.concatenate([tokens[i] for i in ordered])
        owner = np.repeat(np.arange(len(nodes), dtype=np.uint32), np.array(sizes)[ordered])
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        name = xxhash.xxh3_64_intdigest(node.tobytes()) >> 1
        cuts = np.searchsorted(_span_of(token, bits, spans), np.arange(spans + 1))
        first = -(-np.arange(buckets + 1) * spans // buckets)  # of each bucket: span * buckets // spans is the bucket
        rows = []
        for b in range(buckets):
            lo, hi = cuts[first[b]], cuts[first[b + 1]]
            if lo == hi:
                continue
            used, local = np.unique(owner[lo:hi], return_inverse=True)
            rows.append((b, -1, name, pack(np.diff(node[used], prepend=U(0)))))
            for span in range(first[b], first[b + 1]):
                x, y = cuts[span], cuts[span + 1]
                if x < y:
                    rows.append((b, span, name, _block(token[x:y], local[x - lo : y - lo])))
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "span", "flush", "block"])

    def run(batches):
        tokens, nodes, sizes, seen, held = [], [], [], set(), 0
        for _, sets in _documents(batches, width):
            for s in sets:
                if 100 * len(s) < percent * (len(s) + 1):  # such a set has a partner only in itself
                    continue
                key = node_key(s)
                if key in seen:
                    continue
                seen.add(key), tokens.append(s >> U(64 - bits)), nodes.append(key), sizes.append(len(s))
                held += len(s)
            if held >= FLUSH_TOKENS:
                yield from flush(tokens, nodes, sizes)
                tokens, nodes, sizes, seen, held = [], [], [], set(), 0
        if held:
            yield from flush(tokens, nodes, sizes)

    return run


def _of_one_span(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, node, often) of tokens that two or more nodes hold, often: of how many."""
    token, node = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(token)
    token = token[order]
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    token, order = token[keep], order[keep]
    node = node[order]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    if len(token):
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[first], node[first]
    _, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
    often = count[inverse].astype(np.uint32)
    keep = often > 1
    return token[keep], node[keep], often[keep]


def _shared_tokens(buckets: int):
    """Of one token bucket, whose rows come by span: the entries of tokens that two or more nodes hold, with their
    frequency, by node bucket. One span's entries, and FLUSH_TOKENS or so of those kept, are held at a time."""

    def emit(found):
        token, node, often = (np.concatenate(p) for p in zip(*found))
        bucket = (node % U(buckets)).astype(np.int64)
        order = np.lexsort((node, token, bucket))
        token, node, often, bucket = token[order], node[order], often[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        ids, blobs = [], []
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                used, local = np.unique(node[lo:hi], return_inverse=True)
                ids.append(b)
                blobs.append(_block(token[lo:hi], local, often[lo:hi], np.diff(used, prepend=U(0))))
        for i in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64], pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], names=["bucket", "block"])

    def run(batches):
        nodes: dict[tuple[int, int], np.ndarray] = {}
        bucket = at = None
        parts, found, held = [], [], 0
        for batch in batches:
            for b, span, flush, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (b, span) != (bucket, at):
                    found.append(_of_one_span(parts))
                    parts, held = [], held + len(found[-1][0])
                if b != bucket:
                    nodes = {}
                bucket, at = b, span
                if held >= FLUSH_TOKENS:
                    yield from emit(found)
                    found, held = [], 0
                if span < 0:
                    nodes[flush] = np.cumsum(unpack(blob)[0])
                else:
                    gaps, local = unpack(blob)
                    parts.append((np.cumsum(gaps), nodes[flush][local]))
        if parts:
            found.append(_of_one_span(parts))
        if found:
            yield from emit(found)

    return run


def _set_sizes(buckets: int):
    """Blocks of (node, set size) by node bucket, from (node, n)."""

    def run(batches):
        for batch in batches:
            node, n = (c.to_numpy().astype(np.uint64) for c in batch.columns)
            bucket = (node % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            node, n, bucket = node[order], n[order], bucket[order]
            ids = np.unique(bucket)
            cuts = np.append(np.searchsorted(bucket, ids), len(bucket))
            blobs = [pack(node[lo:hi], n[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block"])

    return run


def signatures(token: np.ndarray, often: np.ndarray, size: int, percent: int, frequent: int) -> np.ndarray | None:
    """Signatures of a set of which token (with frequencies often) are the tokens that others hold too.

    None if the set can have no partner. percent: the threshold in hundredths."""
    losses = size - -(-percent * size // 100)  # tokens that may be missing from a partner
    needed = losses + 1 - (size - len(token))
    if needed <= 0:
        return None
    order = np.lexsort((token, often))
    token, often = token[order], often[order]
    rare = int(np.searchsorted(often, frequent, side="right"))
    if needed <= rare:
        return mix(token[:needed])
    out = [mix(token[:rare])]
    needed -= rare
    rest, level = token[rare:], size.bit_length()
    for at in (level, level - 1):  # partners' sizes differ by less than a factor of two
        groups = max(1, (1 << at) >> 3)
        group = mix(rest ^ U(at)) % U(groups)
        # each token after the first of its group raises by one the losses that the prefix survives
        by = np.argsort(group, kind="stable")
        later = np.zeros(len(rest), dtype=np.int64)
        later[by[1:]] = group[by][1:] == group[by][:-1]
        # (for thresholds over 50 %, the groups are few enough that the whole set always suffices)
        length = int(np.searchsorted(np.cumsum(later), needed)) + 1
        out.append(_pairs(rest[:length], group[:length], at))
    return np.unique(np.concatenate(out))


def _pairs(token: np.ndarray, group: np.ndarray, level: int) -> np.ndarray:
    by = np.lexsort((token, group))
    token, group = token[by], group[by]
    out = []
    for gap in range(1, len(token)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(mix(token[:-gap][same] * U(A) + token[gap:][same] * U(P) + U(level + 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(token: np.ndarray) -> list[int]:
    """The words of PARITY: each bit tells whether an odd number of the tokens fall to it."""
    bits = np.bincount((token % U(64 * len(PARITY))).astype(np.int64), minlength=64 * len(PARITY)).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def _signed_sets(percent: int, frequent: int):
    """Per node with possible partners: its set size, its shared tokens (their gaps, packed), its signatures and the
    parity of its shared tokens."""

    def run(batches):
        parts, known = [[], [], []], [[], []]
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                arrays = unpack(blob)
                if len(arrays) > 2:
                    gaps, local, often, used = arrays
                    arrays = np.cumsum(gaps), np.cumsum(used)[local], often
                for p, x in zip(known if len(arrays) == 2 else parts, arrays):
                    p.append(x)
        if not parts[0]:
            return
        token, node, often = (np.concatenate(p) for p in parts)
        whose, size = (np.concatenate(p) for p in known)
        del parts, known
        order = np.argsort(whose)
        whose, size = whose[order], size[order]
        order = np.lexsort((token, node))
        token, node, often = token[order], node[order], often[order]
        begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        end = np.append(begin[1:], len(node))
        rows: list[tuple] = []
        held = 0
        for lo, hi in zip(begin.tolist(), end.tolist()):
            n = int(size[np.searchsorted(whose, node[lo])])
            found = signatures(token[lo:hi], often[lo:hi], n, percent, frequent)
            if found is not None and len(found):
                rows.append((int(node[lo]), n, hi - lo, pack(np.diff(token[lo:hi], prepend=U(0))), (found >> U(1)).astype(np.int64), *parity(token[lo:hi])))
                held += len(found) + hi - lo
            if held > 1_000_000:
                yield _set_batch(rows)
                rows, held = [], 0
        if rows:
            yield _set_batch(rows)

    return run


def _set_batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.list_(pa.int64())), *[pa.array([r[5 + i] for r in rows], pa.int64()) for i in range(len(PARITY))]],
        names=["node", "n", "s", "tokens", "sigs", *PARITY],
    )


def _tokens(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpack(blob.as_py())[0], dtype=np.uint64)


def _counted(batches):
    """(a, b, n_a, n_b, own, common) of (a, b, n_a, n_b, own, tokens_a, tokens_b): how many tokens the two share."""
    for batch in batches:
        a, ta, tb = batch.column(0).to_numpy(), batch.column(5), batch.column(6)
        common = np.zeros(len(a), dtype=np.int64)
        last, x = None, None
        for i in range(len(a)):
            if a[i] != last:
                last, x = a[i], _tokens(ta[i])
            both = np.sort(np.concatenate((x, _tokens(tb[i]))))
            common[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "own", "common"])


def _with_tokens(pairs: DataFrame, sets: DataFrame, one: str, other: str) -> DataFrame:
    """A written table of pairs with the tokens of both, t_{one} and t_{other}. Where pairs are few, only their sets move."""
    body = sets.select("node", "tokens")
    withother = pairs.join(body.select(F.col("node").alias(other), F.col("tokens").alias(f"t_{other}")), other)
    asked = pairs.select(one).distinct().join(body.select(F.col("node").alias(one), F.col("tokens").alias(f"t_{one}")), one)
    return withother.join(asked, one)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, n_a, n_b, own), a written table, with common and linked. Sets travel to a's side once for each b."""
    both = _with_tokens(pairs, sets, "a", "b")
    counted = both.select("a", "b", "n_a", "n_b", "own", "t_a", "t_b").mapInArrow(_counted, "a long, b long, n_a long, n_b long, own long, common long")
    return counted.withColumn("linked", F.expr(f"100 * common >= {percent} * (n_a + n_b - common)"))


def _outside(batches):
    """(node, token) of (node, t_node, t_p): the node's shared tokens that p has not."""
    for batch in batches:
        nodes, mine, theirs = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        kept = [np.setdiff1d(_tokens(mine[i]), _tokens(theirs[i]), assume_unique=True) for i in range(len(nodes))]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, dtype=np.int64), [len(k) for k in kept])), pa.array(np.concatenate(kept).view(np.int64))], names=["node", "token"])


def _beside(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes with the tokens that they share with others but not with their pivot, where a pivot's nodes lie in more
    than one component."""
    around = nodes.where("p <> node")
    mixed = around.groupBy("p").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("p")
    pairs = materialize(around.where("s > c").join(mixed, "p").select("node", "p"), "beside")
    tokens = _with_tokens(pairs, sets, "p", "node").select("node", "t_node", "t_p").mapInArrow(_outside, "node long, token long")
    return tokens.join(nodes, "node")


def _sides(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs a < b of rows that agree in the keys, lie in different components and may link by their sizes and parity.

    Twice a link's intersection is 2 * percent / (100 + percent) of the summed sizes at least. It is also s_a + s_b less
    the number of shared tokens that only one of the two has, which is no less than the number of parity bits that differ."""
    names = [c for c in ("n", "s", "label", "p", "c", *PARITY) if c not in keys]
    one, other = (rows.select(*keys, F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in ("a", "b"))
    apart = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in PARITY)
    near = f"{100 + percent} * (s_a + s_b - ({apart})) >= {2 * percent} * (n_a + n_b)"
    return one.join(other, keys).where("a < b and label_a <> label_b").where(near)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, frequent: int = 32) -> DataFrame:
    """Per document: doc_id, n_shingles (its set's size) and component_id (least doc_id connected with it by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets; percent is 51 at
    least (the similarity's default is 0.75). frequent: document frequency from which tokens are paired."""
    if not 51 <= percent <= 100:
        raise ValueError("percent must be from 51 to 100")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = materialize(texts.mapInArrow(_members(width), "doc_id long, n_shingles long, node long"), "members")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return members.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # Token hashes are cut to as many bits as keep chance agreement negligible at this size.
    bits = min(64, max(44, math.ceil(math.log2(total)) + 12))
    buckets = max(shuffle_partitions(spark), -(-total // SPAN_TOKENS))
    few = min(buckets, max(TOKEN_BUCKETS, spark.sparkContext.defaultParallelism))
    blocks = texts.mapInArrow(_token_blocks(width, bits, buckets, few, percent), "bucket int, span int, flush long, block binary")
    shared = blocks.repartitionById(few, F.col("bucket")).sortWithinPartitions("bucket", "span").mapInArrow(_shared_tokens(buckets), "bucket int, block binary")
    # sizes go to a node's bucket once, and not beside its tokens
    set_sizes = members.where("node is not null").select("node", F.col("n_shingles").alias("n")).distinct().mapInArrow(_set_sizes(buckets), "bucket int, block binary")
    sets = materialize(
        shared.union(set_sizes).repartitionById(buckets, F.col("bucket")).mapInArrow(_signed_sets(percent, frequent), "node long, n long, s long, tokens binary, sigs array<long>" + "".join(f", {x} long" for x in PARITY)), "sets"
    )
    # A link's intersection is percent / (100 + percent) of the summed sizes at least, and no larger than what
    # either set shares with any other.
    fits = f"{100 + percent} * least(s_a, s_b) >= {percent} * (n_a + n_b)"
    # Pivots are the nodes with the fewest tokens of their own: the most central of a family of edited copies.
    signed = sets.select(F.explode("sigs").alias("sig"), "node", (F.col("n") - F.col("s")).alias("own"))
    pivots = signed.groupBy("sig").agg(F.min(F.struct("own", "node")).alias("p"), F.count("*").alias("k")).where("k > 1")
    star = signed.select("sig", "node").join(pivots, "sig").where("node <> p.node").select(F.col("p.node").alias("a"), F.col("p.own").alias("own"), F.col("node").alias("b")).distinct()
    sizes = sets.select("node", "n", "s")
    for x in ("a", "b"):
        star = star.join(sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}")), x)
    star = materialize(star.where(fits).select("a", "b", "n_a", "n_b", "own"), "candidates")
    star = materialize(_verified(star, sets, percent), "star")
    labels = components(star.where("linked"))
    # What is left: pairs of a bucket that lie in different components and are not yet verified. Two nodes that met
    # the same pivot p share at most the lesser of their shares with p, and what they share beside p. So pairs whose
    # shares with p could not do alone must have a token beside p in common: they come from an index of those tokens.
    known = star.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("own", "a", "common")).alias("best"))
    nodes = sets.select("node", "n", "s", *PARITY).join(labels, "node", "left").join(known, "node", "left")
    nodes = materialize(nodes.select("node", "n", "s", *PARITY, F.coalesce("label", "node").alias("label"), F.coalesce("best.a", "node").alias("p"), F.coalesce("best.common", "s").alias("c")), "nodes")
    # labels are joined to whole signature lists, and only nodes of mixed buckets get the rest
    labelled = sets.select("node", "sigs").join(nodes.select("node", "label"), "node").select(F.explode("sigs").alias("sig"), "node", "label")
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    buckets_left = sets.select(F.explode("sigs").alias("sig"), "node").join(mixed, "sig").join(nodes, "node")
    alone = f"(p_a <> p_b or {100 + percent} * least(c_a, c_b) >= {percent} * (n_a + n_b))"
    by_sig = _sides(buckets_left, ["sig"], percent).where(fits).where(alone).select("a", "b", "n_a", "n_b").distinct()
    beside = _sides(_beside(nodes, sets), ["p", "token"], percent).where(fits).where(f"not {alone.replace('p_a <> p_b or ', '')}")
    beside = beside.where(f"{100 + percent} * (least(c_a, c_b) + least(s_a - c_a, s_b - c_b)) >= {percent} * (n_a + n_b)")
    beside = beside.groupBy("a", "b", "n_a", "n_b", F.least("c_a", "c_b").alias("c")).agg(F.count("*").alias("k"))
    beside = beside.where(f"{100 + percent} * (c + k) >= {percent} * (n_a + n_b)").select("a", "b", "n_a", "n_b")
    across = by_sig.union(beside).distinct().withColumn("own", F.lit(0).cast("long"))
    across = across.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = materialize(_verified(materialize(across, "pairs"), sets, percent).where("linked").select("a", "b"), "links")
    labels = components(links.union(nodes.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    least = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    final = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return members.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
