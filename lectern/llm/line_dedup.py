"""Line deduplication with a log-template tree.

Each document is parsed once. A line's tokens are its runs of characters other than ASCII white space; a token that holds
a digit becomes <*> (unless over 30 % of the line's would). A line then goes down a tree of fixed depth: by its token
count, then by its leading DEPTH tokens, to a leaf. In a leaf, the tokens behind are PARTS segments of nearly equal
length, and a template is what is left of a line when one or two of its segments are <*>, with at least SIMILAR of
its tokens fixed. A template holds if two or more different lines of its leaf agree with it; a line belongs to the
one that most lines agree with, and a line without any is a template of its own.

A template recurs across documents by the number of unlike documents that hold it. Documents are alike if
their SHINGLE-word shingles have a similarity of about ALIKE or more: each has a MinHash of BINS values, documents
that agree in one of BANDS bands are compared with the least of them, and those that share ALIKE of the values at
least are linked; copies and near copies, linked to one family, count as one document. So copies neither make their lines recur nor withdraw
support from lines that recur elsewhere, and lines of a long shared block count like single ones. How many unlike
documents are needed depends on a template's length (SUPPORT). Lines of recurring templates are dropped from all
documents; a document of which nothing would be left stays as it is.

Null and empty texts stay as they are, with n_dropped 0. Blank lines are never dropped. Rows that repeat an id and a
text are treated alike, each giving a row. Very long texts are hashed in slices. An empty table gives an empty
result. Extra columns stay, whatever their names; n_lines and n_dropped are put in place of columns of those names. All counts
are over all documents. Groups are only reduced by partial aggregation; hashes are joined, and texts move once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove
from .components import components
from .words import U, Words, mix, range_hashes, range_sums, shingle_hashes, slices, whole_hash, words_of

DEPTH = 3
PARTS = 8
SIMILAR = 0.7
#: Support from which a template recurs, by token count: from so many tokens on, so many unlike documents.
SUPPORT = ((50, 2), (3, 3), (1, 20))
#: Words of a shingle of the documents' MinHash, its values, its bands, and the share that makes documents alike.
#: (Shorter and laxer than near duplicates' five words and 0.75, as those part copies with a few per cent of edits.)
SHINGLE, BINS, BANDS, ALIKE = 3, 64, 21, 0.5
_VARIABLE = U(0x6A09E667F3BCC908)
_EMPTY = 0xFFFFFFFF

#: Bytes of a value of a sketch and of a segment's hash.
_BYTES = 4
_LINE = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("line", pa.int64()), ("leaf", pa.int64()), ("parts", pa.binary())])
_SCHEMA = "uid long, sketch binary, lines array<struct<pos int, n int, line long, leaf long, parts binary>>"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def sketches(found: Words) -> np.ndarray:
    """One-permutation MinHash of each text's shingles: per bin of the hash the least value, or _EMPTY."""
    out = np.full((len(found.counts), BINS), _EMPTY, dtype=np.uint32)
    grams = shingle_hashes(found.hashes, SHINGLE)
    first = np.cumsum(found.counts) - found.counts
    owner = np.repeat(np.arange(len(found.counts)), found.counts)
    at = np.arange(len(grams))
    within = at + SHINGLE <= (first + found.counts)[owner[: len(grams)]] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[within], owner[: len(grams)][within]
    for i in np.flatnonzero((found.counts > 0) & (found.counts < SHINGLE)):
        h = whole_hash(found.hashes[first[i] : first[i] + found.counts[i]])
        grams, owner = np.append(grams, h), np.append(owner, i)
    np.minimum.at(out.reshape(-1), owner * BINS + (grams >> U(58)).astype(np.int64), (grams & U(0xFFFFFFFE)).astype(np.uint32))
    return out


def parsed_lines(found: Words) -> tuple[np.ndarray, ...]:
    """Of all lines with words: text, position, token count, hash, leaf, and the hashes of their segments."""
    data = np.frombuffer(found.data, dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    number = np.searchsorted(breaks, found.starts)  # of the line that a word is in, over all texts
    begin = np.flatnonzero(np.diff(number, prepend=-1))
    end = np.append(begin[1:], len(number))
    text = np.searchsorted(found.ends, found.starts[begin])
    # a text's first line begins behind the break before it
    zero = np.searchsorted(breaks, np.append(0, found.ends[:-1])) + 1
    pos = number[begin] - zero[text]
    n = end - begin
    masked = np.add.reduceat(found.digits.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    tokens = np.where(found.digits & np.repeat(masked <= (1 - SIMILAR) * n, n), _VARIABLE, found.hashes)
    sums = range_sums(tokens)
    line = range_hashes(sums, begin, end)
    head = begin + np.minimum(DEPTH, n)
    leaf = mix(range_hashes(sums, begin, head) * U(3) + n.astype(np.uint64))
    rest = end - head
    edges = [head + rest * i // PARTS for i in range(PARTS + 1)]
    parts = np.column_stack([range_hashes(sums, edges[i], edges[i + 1]) for i in range(PARTS)])
    return text, pos, n, line, leaf, parts


def _parse(batches):
    for batch in batches:
        for part, texts in slices(batch):
            found = words_of(texts, lower=False)
            text, pos, n, line, leaf, parts = parsed_lines(found)
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            # segments matter only where there are some
            width = np.where(n > DEPTH, PARTS * _BYTES, 0)
            segments = _binary(parts[n > DEPTH].astype(np.uint32), width)
            lines = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(_signed(line)), pa.array(_signed(leaf)), segments], fields=list(_LINE))
            sketch = _binary(sketches(found), np.full(len(texts), BINS * _BYTES))
            yield pa.RecordBatch.from_arrays([part.column(0), sketch, pa.ListArray.from_arrays(pa.array(ends), lines)], names=["uid", "sketch", "lines"])


def _binary(values: np.ndarray, widths: np.ndarray) -> pa.Array:
    """Binary values of these widths, cut from the array's bytes in order."""
    at = np.append(0, np.cumsum(widths)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(widths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _bytes(data: Column, begin: int, end: int) -> Column:
    """The values from begin to before end of a packed row of them."""
    return F.substring(data, begin * _BYTES + 1, (end - begin) * _BYTES)


def _linked(batches):
    """(a, b) of (a, b, sketch_a, sketch_b) that agree in ALIKE or more of the bins that one of them fills."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint32).reshape(batch.num_rows, BINS) for c in batch.columns[2:])
        filled = (x != _EMPTY) | (y != _EMPTY)
        alike = ((x == y) & filled).sum(1) >= ALIKE * filled.sum(1)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(alike)) for c in batch.columns[:2]], names=["a", "b"])


def families(parsed: DataFrame) -> DataFrame:
    """(uid, family) of the documents that are like others; family is the least uid that a document is linked with."""
    size = BINS // BANDS
    values = lambda i: _bytes(F.col("sketch"), i * size, (i + 1) * size)
    empty = F.lit(_EMPTY.to_bytes(_BYTES, "little") * size)
    bands = [F.when(values(i) != empty, F.xxhash64(F.lit(i), values(i))) for i in range(BANDS)]
    banded = materialize(parsed.select("uid", F.explode(F.array_compact(F.array(*bands))).alias("band")), "bands")
    least = banded.groupBy("band").agg(F.min("uid").alias("a"), F.max("uid").alias("most")).where("a < most").select("band", "a")
    pairs = materialize(banded.join(least, "band").where("uid <> a").select("a", F.col("uid").alias("b")).distinct(), "alike-pairs")
    wanted = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    known = materialize(parsed.select("uid", "sketch").join(wanted, "uid", "left_semi").distinct(), "sketches")
    both = pairs
    for x in ("a", "b"):
        both = both.join(known.select(F.col("uid").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)
    links = materialize(both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_linked, "a long, b long"), "alike")
    found = components(links, "families").select(F.col("node").alias("uid"), F.col("label").alias("family"))
    for used in (banded, pairs, known, links):
        remove(used)
    return found


def _masks() -> list[tuple[int, ...]]:
    return [m for k in (1, 2) for m in combinations(range(PARTS), k)]


def _beside(parts: Column, mask: tuple[int, ...]) -> list[Column]:
    """The segments' hashes less those of the mask, in runs."""
    cuts = [-1, *mask, PARTS]
    return [_bytes(parts, a + 1, b) for a, b in zip(cuts, cuts[1:]) if b > a + 1]


def _templates(n: Column, leaf: Column, parts: Column) -> Column:
    """The hashes of what is left of a line when one or two of its segments, none of them empty, are variable."""
    rest = n - DEPTH
    size = [F.floor(rest * (i + 1) / PARTS) - F.floor(rest * i / PARTS) for i in range(PARTS)]
    made = []
    for mask in _masks():
        some = [size[i] > 0 for i in mask]
        allowed = some[0] & some[-1] & (n - sum((size[i] for i in mask[1:]), size[mask[0]]) >= SIMILAR * n)
        made.append(F.when(allowed, F.xxhash64(leaf, F.lit(str(mask)), *_beside(parts, mask))))
    return F.array_compact(F.array(*made))


def members(lines: DataFrame) -> DataFrame:
    """(line, template) of the lines of (line, n, leaf, parts) that belong to a template of several lines."""
    long = materialize(lines.where(f"n > {DEPTH}").distinct(), "long-lines")
    # With two of the segments variable at most, lines of a template agree in one of three blocks of segments.
    blocks = [(0, 3), (3, 6), (6, PARTS)]
    held = [F.xxhash64("leaf", F.lit(k), _bytes(F.col("parts"), *b)) for k, b in enumerate(blocks)]
    blocked = long.select("line", F.explode(F.array(*held)).alias("block"))
    shared = blocked.groupBy("block").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("block")
    likely = blocked.join(shared, "block", "left_semi").select("line").distinct()
    made = materialize(long.join(likely, "line", "left_semi").select("line", F.explode(_templates(F.col("n"), F.col("leaf"), F.col("parts"))).alias("template")), "templates")
    tally = made.groupBy("template").agg(F.count("*").alias("c")).where("c > 1")
    best = made.join(tally, "template").groupBy("line").agg(F.max(F.struct("c", "template")).alias("b")).select("line", "b.template")
    best = materialize(best, "members")
    remove(long), remove(made)
    return best


def recurring(held: DataFrame) -> DataFrame:
    """Templates that enough unlike documents hold, of (template, n, family)."""
    tally = held.groupBy("template", "family").agg(F.max("n").alias("n")).groupBy("template").agg(F.count("*").alias("unlike"), F.max("n").alias("n"))
    needed = F.lit(None).cast("int")
    for tokens, least in reversed(SUPPORT):
        needed = F.when(F.col("n") >= tokens, F.lit(least)).otherwise(needed)
    return tally.where(F.col("unlike") >= needed).select("template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their text less its recurring lines, n_lines and n_dropped; other columns stay."""
    text = F.col(f"`{text_col}`")
    uid = F.xxhash64(F.col(f"`{id_col}`"), text)
    parsed = materialize(docs.select(uid.alias("uid"), text.alias("text")).mapInArrow(_parse, _SCHEMA), "parsed")
    lines = parsed.select("uid", F.explode("lines").alias("x")).select("uid", "x.*")
    # only lines of a template that more than one document holds can recur
    keyed = lines.select("uid", "pos", "n", "line").join(members(lines.select("line", "n", "leaf", "parts")), "line", "left").select("uid", "pos", "n", F.coalesce("template", "line").alias("template"))
    keyed = materialize(keyed, "keyed")
    # (lists of templates are written, so that a join with them has an exchange on both sides and can split a hot one)
    repeated = keyed.groupBy("template").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo < hi").select("template")
    shared = keyed.join(materialize(repeated, "repeated"), "template", "left_semi").join(families(parsed), "uid", "left")
    shared = materialize(shared.select("uid", "pos", "n", "template", F.coalesce("family", "uid").alias("family")), "shared")
    remove(keyed)
    remove(parsed)
    drops = shared.join(materialize(recurring(shared), "recurring"), "template", "left_semi").groupBy("uid").agg(F.collect_set("pos").alias("drop"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("text"), uid.alias("uid")).join(drops, "uid", "left")
    # a step of its own, so that each text is split once
    rows = rows.select("row", "text", "drop", F.split("text", "\n").alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get("lines", i))
    rows = rows.select("row", "text", F.size("lines").alias("size"), F.when(F.col("drop").isNotNull(), kept).alias("rest"))
    # nothing left: no line with more than white space
    some = F.exists("rest", lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    rows = rows.select("row", "text", "size", F.when(some, F.col("rest")).alias("rest"))
    new = F.coalesce(F.array_join("rest", "\n"), F.col("text"))
    columns = [new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names]
    dropped = F.coalesce(F.col("size") - F.size("rest"), F.lit(0))
    return rows.select(*columns, F.coalesce("size", F.lit(0)).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
