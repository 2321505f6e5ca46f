"""Document fingerprints by a homomorphic multiset hash; DataFrame functions only.

A text is a multiset of paragraphs, and a paragraph of pieces: clauses with the marks that end them, cut to
PIECE characters where no mark comes. Each piece is hashed to a wide vector; a fingerprint is the sum of the vectors
of its pieces, lane by lane modulo 2^32:

  lane 0        1 for each piece: the number of pieces
  lanes 1-4     128 bits of the piece's hashes: two multisets agree by chance with probability 2^-128 or so
  lanes 5-36    two lanes each: the bits of a 64-bit hash, whose sums are a random projection of the multiset

So fingerprints do not depend on order; they can be added and subtracted as pieces come and go (combine, remove);
equal texts have equal fingerprints; and the cosine of the projections estimates that of the multisets (with_likeness).
Null texts count as empty; the empty text's fingerprint is zero, and its likeness is 1 to itself and 0 to others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

PIECE = 24
MASK = 0xFFFFFFFF
#: Bits j and j + 32 of a hash.
PAIR = 0x100000001
SIGNS = 64


def pieces(text: Column, length: int = PIECE) -> Column:
    ends = r"\n.!?,;"
    return F.regexp_extract_all(text, F.lit(rf"[^{ends}]{{0,{length}}}[{ends}]+|[^{ends}]{{1,{length}}}"), F.lit(0))


def _total(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + f(h))


def from_hashes(hashes: Column) -> Column:
    """The vector of a multiset given as an array of structs (s: sign hash, t: strong hash) of its pieces."""
    low = lambda x: x.bitwiseAND(F.lit(MASK))
    strong = [
        _total(hashes, lambda h: low(h.t)), _total(hashes, lambda h: F.shiftrightunsigned(h.t, 32)),
        _total(hashes, lambda h: low(F.xxhash64(h.t, F.lit(3)))), _total(hashes, lambda h: F.shiftrightunsigned(F.xxhash64(h.t, F.lit(3)), 32)),
    ]
    signs = [_total(hashes, lambda h, j=j: F.shiftrightunsigned(h.s, j).bitwiseAND(F.lit(PAIR))) for j in range(32)]
    return F.array(F.size(hashes).cast("long"), *map(low, strong), *signs)


def hashed(text: Column) -> Column:
    return F.transform(pieces(text), lambda p: F.struct(F.xxhash64(p, F.lit(1)).alias("s"), F.xxhash64(p, F.lit(2)).alias("t")))


def _lanes(f):
    """Apply f to each lane of two vectors; the lanes from 5 on hold two 32-bit halves, which must not run together."""

    def lane(x: Column, i: Column) -> Column:
        high = f(F.shiftrightunsigned(x.a, 32), F.shiftrightunsigned(x.b, 32)).bitwiseAND(F.lit(MASK))
        low = f(x.a.bitwiseAND(F.lit(MASK)), x.b.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
        return F.when(i < 5, low).otherwise(F.shiftleft(high, 32).bitwiseOR(low))

    return lambda a, b: F.transform(F.zip_with(a, b, lambda p, q: F.struct(p.alias("a"), q.alias("b"))), lane)


combine = _lanes(lambda a, b: a + b)
remove = _lanes(lambda a, b: a - b)


def _signed(vector: Column) -> Column:
    """The projection: for each of 64 bits, pieces that have it less pieces that do not."""
    n = F.element_at(vector, 1)
    packed = F.slice(vector, 6, 32)
    return F.concat(
        F.transform(packed, lambda x: (x.bitwiseAND(F.lit(MASK)) * 2 - n).cast("double")),
        F.transform(packed, lambda x: (F.shiftrightunsigned(x, 32) * 2 - n).cast("double")),
    )


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with a column of that name, 0 to 1: the estimated cosine of the multisets of two vectors.

    In steps, so that no projection is worked out twice."""
    df = df.withColumns({"_x": _signed(F.col(a)), "_y": _signed(F.col(b))})
    df = df.withColumns({"_xy": _dot(F.col("_x"), F.col("_y")), "_scale": F.sqrt(_dot(F.col("_x"), F.col("_x")) * _dot(F.col("_y"), F.col("_y")))})
    cosine = F.when(F.col("_scale") > 0, F.col("_xy") / F.col("_scale")).otherwise(F.lit(0.0))
    near = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)), 6))
    return df.withColumn(name, near).drop("_x", "_y", "_xy", "_scale")


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the vector of a text column; the hashes are a step of their own, or each lane would hash anew."""
    return df.withColumn("_hashes", hashed(F.col(text))).withColumn(name, from_hashes(F.col("_hashes"))).drop("_hashes")


def as_text(vector: Column) -> Column:
    return F.concat_ws("", F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars and its fingerprint, as a vector (array of long) and as text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_vector(texts.withColumn("n_chars", F.char_length("text").cast("long")), "text", "vector")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited text: its last third replaced by the next document's start.

    Next is the next lower doc_id (null below all; ties by text), after the last the first; a single row is its own
    next. Documents are dealt into doc_id ranges whose limits are documents too, and each range also gets the
    document that begins the next one: texts are shuffled once, and no range needs another's rows."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    wanted = max(2, shuffle_partitions(spark))
    found = docs.agg(F.max(key).alias("top"), F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10000).alias("at")).first()
    prints = fingerprints(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    limits = sorted({found["top"], *(found["at"] or [])}, reverse=True) if found["top"] is not None else [0]
    edges, n = F.array(*[F.lit(x).cast("long") for x in limits]), len(limits)
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    # binary search: the number of limits at or above the key
    place = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
            F.when(F.element_at(edges, F.floor((s.lo + s.hi) / 2).cast("int") + 1) >= F.col("key"), F.struct((F.floor((s.lo + s.hi) / 2).cast("int") + 1).alias("lo"), s.hi.alias("hi")))
            .otherwise(F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi")))
        ),
        lambda s: s.lo - 1,
    )
    placed = prints.withColumn("own", place)
    first = F.element_at(edges, F.col("own") + 1) == F.col("key")
    real = F.struct(F.col("own").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("own") + n - 1, F.lit(n)).alias("range"), F.lit(True).alias("ghost"))
    dealt = placed.withColumn("r", F.explode(F.when(first, F.array(real, ghost)).otherwise(F.array(real)))).select("doc_id", "text", "n_chars", "vector", "key", "r.range", "r.ghost")
    w = Window.partitionBy("range").orderBy("ghost", F.desc("key"), "text")
    followed = (
        dealt.repartitionById(max(wanted, n), F.col("range"))
        .withColumns({"next_text": F.lead("text").over(w), "next_vector": F.lead("vector").over(w)})
        .where("not ghost")
    )
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = followed.select(
        "doc_id", "n_chars", "vector", "next_vector",
        F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
    )
    out = with_vector(edited, "edited", "edited_vector").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    out = with_likeness(with_likeness(out, "vector", "edited_vector", "near_edited"), "vector", "next_vector", "near_next")
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
