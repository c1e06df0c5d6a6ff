"""Hierarchical packing of token ids into windows of several lengths.

Every document's ids (with its end id) are cut into full windows of the longest tier and one remainder. A remainder
is routed to the shortest tier that holds it. Each tier, the longest first, is packed by itself: each of its remainders
opens a window, and what is left of that, less than half, is filled from the shorter tiers, the longest that fits first,
and at last by the head of a remainder that is cut. So a window is full unless the buffer has run out. Tiers are powers of
two, so full windows need no padding; only the last window of a partition may.

Packing needs no shuffle: each input partition is packed by itself, in buffers bounded by tokens, and a partition
leaves at most one padded window. Window ids join partition and number, so a lost task yields the same ids again.

Step groups: the windows of one tier are numbered through all partitions (one number for each partition and tier says
where its own begin), so many to a group that each holds the same number of tokens; of each tier only the last group may
be short, whatever the number of partitions.

Defined results: a null text is empty; an empty text is its end id alone; a null doc_id stays null; repeated rows are
packed as often as they stand; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, id_and_text, map_arrow
from .tokens import default_path, tokenizer

TIERS = (128, 256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 1 << 16
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1 << 20
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_PACKED = SCHEMA.replace("step_group", "number")
_TYPES = [pa.int64()] * 7 + [pa.int32(), pa.int64()]


class Packer:
    """Packs a stream of (doc_id, ids as bytes). Pieces come out as column lists."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError(f"tiers must be ascending powers of two: {tiers}")
        self.tiers, self.step_tokens, self.buffer_tokens = tiers, max(step_tokens, tiers[-1]), buffer_tokens
        self.base, self.windows, self.made = partition << 40, 0, [0] * len(tiers)
        self.docs: dict[int, tuple] = {}
        self.rest: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of each tier: (length, document's key, start), ascending when packed
        self.held, self.keys = 0, 0
        self.out: list[list] = [[] for _ in _TYPES]

    def _window(self, pieces: list[tuple[int, int, int]]) -> None:
        """One window of (length, key, start) pieces; its tier is the shortest that holds them."""
        used = sum(p[0] for p in pieces)
        k = bisect_left(self.tiers, used)
        offset, number = 0, self.made[k]
        for length, key, start in pieces:
            doc_id, ids, n = self.docs[key]
            for column, value in zip(self.out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, self.base + self.windows, offset, self.tiers[k], number), strict=True):
                column.append(value)
            offset += length
        self.windows += 1
        self.made[k] += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, top, key = len(ids) // 4, self.tiers[-1], self.keys
        self.keys += 1
        self.docs[key] = (doc_id, memoryview(ids), n)
        for start in range(0, n - top + 1, top):
            self._window([(top, key, start)])
        if n % top:
            self._route(n % top, key, n - n % top)
            self.held += n
        else:
            del self.docs[key]
        if self.held > self.buffer_tokens:
            self.pack(last=False)

    def _route(self, length: int, key: int, start: int) -> None:
        self.rest[bisect_left(self.tiers, length)].append((length, key, start))

    def _longest(self, gap: int) -> tuple[int, int, int] | None:
        """Takes the longest remainder that fits from the tiers that may hold one."""
        for k in range(bisect_left(self.tiers, gap), -1, -1):
            if at := bisect_right(self.rest[k], (gap, self.keys, 0)):
                return self.rest[k].pop(at - 1)
        return None

    def _head(self, gap: int) -> tuple[int, int, int] | None:
        """Cuts the head off the shortest remainder."""
        for tier in self.rest:
            if tier:
                length, key, start = tier.pop(0)
                insort(self.rest[bisect_left(self.tiers, length - gap)], (length - gap, key, start + gap))
                return gap, key, start
        return None

    def pack(self, last: bool) -> None:
        """Packs what is held. Unless it is the last time, what fills no window stays for the next."""
        for tier in self.rest:
            tier.sort()
        for k in reversed(range(len(self.tiers))):
            while self.rest[k]:
                pieces = [self.rest[k].pop()]
                gap = self.tiers[k] - pieces[0][0]
                while gap and (piece := self._longest(gap) or self._head(gap)):
                    pieces.append(piece)
                    gap -= piece[0]
                if not gap:
                    self._window(pieces)
                elif last:
                    self._tail(pieces)
                else:  # there was nothing else left
                    for piece in pieces:
                        self._route(*piece)
                    break
        kept = {key for tier in self.rest for _, key, _ in tier}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        self.held = sum(self.docs[k][2] for k in kept)

    def _tail(self, pieces: list[tuple[int, int, int]]) -> None:
        """The last pieces, in full windows of falling tiers; less than the shortest tier remains to be padded."""
        left = sum(p[0] for p in pieces)
        for tier in (*reversed(self.tiers), left):
            while left and tier <= left:
                window, need = [], tier
                while need:
                    length, key, start = pieces.pop(0)
                    window.append((min(length, need), key, start))
                    if length > need:
                        pieces.insert(0, (length - need, key, start + need))
                    need -= window[-1][0]
                self._window(window)
                left -= tier
            if tier == self.tiers[0] and left:
                self._window(pieces)
                return

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, [[] for _ in _TYPES]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, _TYPES, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row for each piece: see SCHEMA. ``length`` ids from ``start`` of the document stand at ``offset`` of the window."""
    path, end = tokenizer_path or default_path(), np.array([END_ID], np.uint32).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, buffer_tokens)
        with tokenizer(path) as known:
            for rows in batches:
                for doc_id, ids in zip(rows["doc_id"].to_pylist(), known.encode(rows["text"].to_pylist()), strict=True):
                    packer.add(doc_id, ids + end)
                if packer.out[0]:
                    yield packer.take()
        packer.pack(last=True)
        if packer.out[0]:
            yield packer.take()

    return step_groups(durable(map_arrow(id_and_text(docs), pack, _PACKED)), max(step_tokens, tiers[-1]))


def step_groups(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Puts the group's number in place of ``number``, a window's within its partition and tier."""
    part = F.shiftright("sequence_id", 40)
    counts = sorted((r["tier"], r["part"], r["n"]) for r in packed.groupBy("tier", part.alias("part")).agg(F.max("number").alias("n")).collect())
    begins, at, tier_of = [], 0, None  # a row for each partition and tier
    for tier, p, n in counts:
        at = 0 if tier != tier_of else at
        begins.append((tier, p, at))
        at, tier_of = at + n + 1, tier
    where = F.broadcast(packed.sparkSession.createDataFrame(begins, "__tier int, __part long, __begin long"))
    joined = packed.join(where, (F.col("tier") == F.col("__tier")) & (part == F.col("__part")))
    group = F.col("tier").cast("long") * (1 << 40) + F.floor((F.col("__begin") + F.col("number")) / (F.lit(step_tokens) / F.col("tier")))
    return joined.select(*(c for c in packed.columns if c != "number"), group.cast("long").alias("step_group"))
