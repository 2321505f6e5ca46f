"""Hierarchical packing of tokenised documents into sequences of several lengths.

Tiers are context sizes: 1024, 512, 256 and 128 ids. A document is its ids with a separator id behind; it is routed to
the shortest tier that takes it whole. One that no tier takes fills windows of the longest tier, and its rest is routed.
A partition packs a bufferful at a time, tier by tier, longest first:

  a sequence of a tier begins with the tier's longest piece that waits;
  its gap takes the longest piece of any tier that fits, shorter tiers included, again and again;
  what no piece fits takes a cut of the next piece, whose rest is routed anew.

So every sequence holds its tier's length exactly, and pieces that fill no gap are packed in sequences of their own
tier. Less than one sequence of each tier waits for the next bufferful; at a partition's end that is cut into sequences
of power-of-two lengths. No sequence needs padding.

Step groups balance tokens: sequences are dealt to the open group while they fit its STEP_TOKENS; those that do
not fit wait for the next one, largest first, so a group holds just STEP_TOKENS; where too
many wait, it is closed, less than one sequence of the longest tier (3 %) short. A partition's last group or two hold what
is left.

One pass over the documents, no shuffle: memory is a buffer of BUFFER pieces, the open group and one document. A
partition's numbering depends on its rows alone, so a lost task's retry gives the same result while its input is a
table. Null and empty texts are a document of the separator alone. Very long texts fill many windows. Repeated rows are
packed each. Ties in length go by arrival. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (1024, 512, 256, 128)
LONGEST = TIERS[0]
SEPARATOR = 0
#: Pieces that wait to be packed together.
BUFFER = 2048
#: Tokens of a step group.
STEP_TOKENS = 32 * LONGEST
#: Sequences that wait for the next step group at most.
MOST_WAITING = 64
#: Outside Latin script and usual punctuation the two tokenizer libraries' character tables may differ.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‟…€]").search


class ByteBPE:
    """Ids that a tokenizers file gives with its default settings: the file's special tokens in a text count as such.

    Usual texts go through the same vocabulary's ranks in tiktoken, which is several times faster (tests hold both against
    each other); texts with a special token, or with unusual characters, through tokenizers."""

    def __init__(self, path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path or P.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks_path = ranks_path or (P.path("byte_bpe_50k.tiktoken") if path is None else None)
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or not _UNUSUAL(text)) and not any(s in text for s in self.special):
            return self.fast(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def tier_of(length: int) -> int:
    return next(t for t in reversed(TIERS) if length <= t)


class Waiting:
    """Pieces of one tier by length; the longest that fits is found by bisection, ties in order of arrival."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.pieces: list[tuple] = []
        self.total = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        at = bisect_left(self.sizes, n)  # before its equals: the earliest are taken first, from the end
        self.sizes.insert(at, n)
        self.pieces.insert(at, piece)
        self.total += n

    def take(self, most: int) -> tuple | None:
        at = bisect_right(self.sizes, most) - 1
        if at < 0:
            return None
        self.total -= self.sizes.pop(at)
        return self.pieces.pop(at)


class StepGroups:
    """Deals sequences to groups of STEP_TOKENS; rows leave in order of their groups."""

    def __init__(self, base: int) -> None:
        self.group, self.room = base, STEP_TOKENS
        self.held: deque = deque()
        self.rows: list[tuple] = []

    def add(self, length: int, rows: list[tuple]) -> None:
        if length > self.room:
            self.held.append((length, rows))
            if len(self.held) > MOST_WAITING:
                self.close()
            return
        self.room -= length
        self.rows += [(*r, self.group) for r in rows]
        if not self.room:
            self.close()

    def close(self) -> None:
        self.group, self.room = self.group + 1, STEP_TOKENS
        again, self.held = sorted(self.held, key=lambda x: -x[0]), deque()
        for length, rows in again:
            self.add(length, rows)


class Packer:
    """Packs the pieces (doc, start, ids, doc_tokens) of one partition; rows are those of SCHEMA."""

    def __init__(self, base: int) -> None:
        self.sequence = base - 1
        self.tiers = {t: Waiting() for t in TIERS}
        self.groups = StepGroups(base)

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for at in range(0, n - LONGEST + 1, LONGEST):
            self._emit([(doc, at, ids[at : at + LONGEST], n)], LONGEST)
        if rest := n % LONGEST:
            self._route((doc, n - rest, ids[n - rest :].copy(), n))
            if sum(len(w.sizes) for w in self.tiers.values()) >= BUFFER:
                self.pack()

    def _route(self, piece: tuple) -> None:
        self.tiers[tier_of(len(piece[2]))].add(piece)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        self.sequence += 1
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, tier))
            offset += len(ids)
        self.groups.add(offset, rows)

    def _longest(self, tier: int, most: int) -> tuple | None:
        """The longest piece of the tier and the shorter ones that is no longer than most."""
        return next((p for t in TIERS if t <= tier and (p := self.tiers[t].take(most))), None)

    def _cut(self, tier: int, gap: int) -> tuple:
        """The front of the shortest tier's next piece; its rest is routed anew. All waiting pieces are longer than the gap."""
        doc, start, ids, n = next(p for t in reversed(TIERS) if t <= tier and (p := self.tiers[t].take(t)))
        self._route((doc, start + gap, ids[gap:], n))
        return doc, start, ids[:gap], n

    def pack(self) -> None:
        """Full sequences of each tier, longest first, as long as its pieces and those of shorter tiers can fill one."""
        for tier in TIERS:
            own = self.tiers[tier]
            while own.sizes and sum(self.tiers[t].total for t in TIERS if t <= tier) >= tier:
                pieces, gap = [], tier
                while gap:
                    piece = self._longest(tier, gap) or self._cut(tier, gap)
                    pieces.append(piece)
                    gap -= len(piece[2])
                self._emit(pieces, tier)

    def finish(self) -> None:
        self.pack()
        queue = deque(p for t in TIERS for p in reversed(self.tiers[t].pieces))
        left = sum(len(p[2]) for p in queue)
        while left:
            length = min(LONGEST, 1 << (left.bit_length() - 1))
            left -= length
            pieces, gap = [], length
            while gap:
                doc, start, ids, n = queue.popleft()
                if len(ids) > gap:
                    queue.appendleft((doc, start + gap, ids[gap:], n))
                    ids = ids[:gap]
                pieces.append((doc, start, ids, n))
                gap -= len(ids)
            self._emit(pieces, length)
        while self.groups.held:
            self.groups.close()


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's length)
    and step_group.

    tokenizer_path: a tokenizers file; none: the public byte-level BPE of 50k."""
    path = tokenizer_path

    def run(batches):
        encode = ByteBPE(path)
        packer = Packer(TaskContext.get().partitionId() << 40)

        def rows(everything: bool = False):
            made = packer.groups
            while len(made.rows) >= 4096 or everything and made.rows:
                some, made.rows = made.rows[:4096], made.rows[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some), _COLUMNS)], names=[n for n, _ in _COLUMNS])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.array([*encode(text.as_py() or ""), SEPARATOR], dtype="<u4"))
            yield from rows()
        packer.finish()
        yield from rows(everything=True)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)
