"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Each block of ids is coded by its own model, empty at its start. The model has three frequency distributions over ids: of
order 2 (what followed the last two ids), order 1 and order 0, and a flat one. A table that is indexed by how sure orders
2 and 1 are (occurrences and distinct successors of the context) mixes them: it holds the adaptive shares of the four,
by which of them was the highest to know the id. A range coder codes that choice and the id's place in that
distribution in one interval.

So that numpy can code many ids at a step, a block is dealt over lanes of STEPS consecutive ids with a coder each, which
share the model; it learns from all lanes' earlier steps, whenever the number of steps has doubled.
Decoding mirrors every step.

A frame is a row of the file: the documents' ids and lengths, the blocks and their crc32. Files hold frames in
ascending doc_id order (range partitions, then sorted), numbered by part and frame; each frame says how many ids of
its part stand before it. Frames are written by Spark's own committer, so executors may be lost at any time.

Defined results: null text is empty; an empty text is its end id alone; null ids come first and stay null;
repeated rows are written each, rows that share a doc_id in the order of their texts' hashes; an empty table gives no frames;
other columns are ignored. Ids need 16 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_and_text, map_arrow, shuffle_partitions
from .tokens import default_path, tokenizer

END_ID = 0
#: Ids of a block at most, ids of a lane, and ids of a frame at most unless one document has more: so a frame is one block, and
#: no few ids are left over to a block that takes as many steps as a full one.
BLOCK_IDS, STEPS, FRAME_IDS = 1 << 20, 256, 1 << 20
#: Steps after which the model learns what was coded.
LEARN_AT = (1, 2, 4, 8, 16, 32, 64, 128)
MAGIC = b"LSF2"
_IDS = 1 << 16
#: Interval of 56 bits; 16 are shifted out when settled, and it is kept wide enough for shares times occurrences.
_TOP, _BOTTOM, _MASK = 1 << 40, 1 << 37, (1 << 56) - 1
#: What a lane is multiplied by that doesn't shift, and one that does.
_FACTOR = np.array([1, 1 << 16], np.int64)
#: The shares of a context of the mix add up to this power of two.
_SHARE_BITS = 12
#: Steps of sureness of one order: none; then by occurrences (powers of two up to 64) and distinct successors among them.
_SURE = 1 + 7 * 4
#: By the occurrences, 64 at most, the first step that they may take.
_SIZE = np.array([1 + (n.bit_length() - 1) * 4 for n in range(65)], np.int64)
_FLAT = np.arange(_IDS, dtype=np.int32)
FRAME_SCHEMA = "part int, frame int, ids_before long, n_ids long, n_docs int, payload binary"


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones; those in ascending order, how often each occurs, and a place of each. Keys
    have 43 bits at most and their number 20, so that one sort of plain integers carries the places."""
    packed = keys << 20
    packed |= np.arange(len(keys))
    packed.sort()
    new = np.ones(len(keys), bool)
    np.greater_equal(packed[1:] ^ packed[:-1], 1 << 20, out=new[1:])
    ranks = np.cumsum(new, dtype=np.int32)
    ranks -= 1
    first = np.flatnonzero(new)
    distinct = packed[first]
    packed &= 0xFFFFF
    rank = np.empty(len(keys), np.int32)
    rank[packed] = ranks
    return rank, distinct >> 20, np.diff(first, append=len(keys)), distinct & 0xFFFFF


def _begins(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of n contexts begins among ascending keys, whose contexts these are, and the end."""
    after = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=n), out=after[1:])
    return after


def _sureness(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    spread = (distinct * 2 > total).view(np.int8) + (distinct * 8 > total).view(np.int8) + (distinct * 32 > total).view(np.int8)
    return np.where(total > 0, _SIZE.take(np.minimum(total, 64)) + spread, 0)


class _Mix:
    """Adaptive shares of orders 2, 1, 0 and the flat distribution, for each pair of surenesses."""

    def __init__(self):
        self.counts = np.tile(np.array([4, 4, 4, 1], np.int64), (_SURE * _SURE, 1))
        self._share()

    def _share(self) -> None:
        whole = 1 << _SHARE_BITS
        self.share = 1 + self.counts * (whole - 4) // self.counts.sum(1, keepdims=True)
        self.share[:, 3] = whole - self.share[:, :3].sum(1)
        self.starts = np.cumsum(self.share, 1) - self.share
        self.flat_share, self.flat_starts = self.share.reshape(-1), self.starts.reshape(-1)
        self.ends = [np.repeat(self.starts[:, k], 4) for k in (1, 2, 3)]  # by four times the context

    def learn(self, chosen: np.ndarray) -> None:
        """``chosen``: context times four plus the choice, for each id of a stretch of steps."""
        self.counts = (self.counts + 1 >> 1) + 16 * np.bincount(chosen, minlength=self.counts.size).reshape(self.counts.shape)
        self._share()


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps of all lanes, and lanes that have one id more."""
    lanes = max(1, n // STEPS)
    return lanes, n // lanes, n % lanes


def _stretches(steps: int) -> list[tuple[int, int]]:
    cuts = [0, *(t for t in LEARN_AT if t < steps), steps]
    return list(zip(cuts, cuts[1:]))


def _renormalise(low: np.ndarray, width: np.ndarray, shift) -> None:
    """Carryless: shifts settled bits out; a narrow interval that straddles a border is cut there first. ``shift`` gets
    the lanes. Those of the first time are many, and worked on as whole arrays; few need a second one."""
    while True:
        differ = low + width
        differ ^= low
        settled = differ < _TOP
        some = width < _BOTTOM
        some |= settled
        straddles = (some > settled).nonzero()[0]
        if len(straddles):
            width[straddles] = -low[straddles] & (_BOTTOM - 1)
        lanes = some.nonzero()[0]
        if not len(lanes):
            return
        shift(lanes, low)
        if 8 * len(lanes) > len(low):
            factor = _FACTOR.take(some.view(np.int8))
            low *= factor
            low &= _MASK
            width *= factor
        else:
            low[lanes] = (low[lanes] << 16) & _MASK
            width[lanes] <<= 16


def _known(counts: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the counts before each key, and total and sureness of the contexts, whose keys begin at ``after``."""
    sums, kinds = np.zeros(len(counts) + 1, np.int32), np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, dtype=np.int32, out=sums[1:])
    np.cumsum(counts > 0, dtype=np.int32, out=kinds[1:])
    total = np.diff(sums[after])
    return sums, total, _sureness(total, np.diff(kinds[after]))


def encode_block(ids: np.ndarray) -> bytes:
    """At most BLOCK_IDS ids: the lengths of the lanes' bytes, then those."""
    lanes, steps, more = _shape(len(ids))
    grid = np.ascontiguousarray(ids[: lanes * steps].reshape(lanes, steps).T).astype(np.int64)
    pairs, keys, _, _ = _ranked((grid[:-1] << 16 | grid[1:]).reshape(-1))
    after_one = _begins(keys >> 16, _IDS)
    pairs = pairs.reshape(-1, lanes)  # of steps 1, 2, ...
    triples, triple_keys, _, _ = _ranked((pairs[:-1].astype(np.int64) << 16 | grid[2:]).reshape(-1))
    after_two = _begins(triple_keys >> 16, len(keys))
    triples = triples.reshape(-1, lanes)
    mix = _Mix()
    low, width = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)
    sent: list[np.ndarray] = []  # at each shift its lanes, and 16 bits of each
    owners: list[np.ndarray] = []

    def shift(some: np.ndarray, value: np.ndarray) -> None:
        sent.append((value[some] >> 40).astype(np.uint16))
        owners.append(some.astype(np.uint16))

    for at, until in _stretches(steps):
        x = grid[at:until].reshape(-1)
        count = np.bincount(grid[:at].reshape(-1), minlength=_IDS).astype(np.int32)
        seen = count > 0  # of the others the flat distribution
        start = np.where(seen, np.cumsum(count, dtype=np.int32) - count, _FLAT).take(x)
        total = np.where(seen, np.int32(at * lanes), np.int32(_IDS)).take(x)
        choice = np.where(seen, np.int16(2), np.int16(3)).take(x)
        count = np.maximum(count, 1).take(x)
        if at > 1:
            for k, ranks, owner, context_of, n, after in (
                (1, pairs, pairs[at - 1 : until - 1], grid[at - 1 : until - 1], len(keys), after_one),
                (0, triples, triples[at - 2 : until - 2], pairs[at - 2 : until - 2], len(triple_keys), after_two),
            ):
                owner, context_of = owner.reshape(-1), context_of.reshape(-1)
                sums, totals, sure = _known(np.bincount(ranks[: at - 2 + k].reshape(-1), minlength=n), after)
                surer = (sure * (4 if k else 4 * _SURE)).astype(np.int16).take(context_of)
                context = surer if k else context + surer
                begin = sums.take(owner)
                own = sums[1:].take(owner)
                own -= begin
                begin -= sums[after[:-1]].take(context_of)
                hit = own > 0
                choice += (k - choice) * hit
                hit = hit.astype(np.int32)  # where it is 1, this order's in place of the lower one's
                for of, here in ((count, own), (total, totals.take(context_of)), (start, begin)):
                    here -= of
                    here *= hit
                    of += here
            choice += context
        chosen = choice.astype(np.int64)
        share, begin = mix.flat_share.take(chosen).reshape(-1, lanes), mix.flat_starts.take(chosen).reshape(-1, lanes)
        total, start, count = (of.reshape(-1, lanes).astype(np.int64) for of in (total, start, count))
        for t in range(until - at):
            unit = width >> _SHARE_BITS
            part = unit * share[t]
            part //= total[t]
            unit *= begin[t]
            low += unit
            low += part * start[t]
            np.multiply(part, count[t], out=width)
            _renormalise(low, width, shift)
        mix.learn(chosen)
    if more:  # fewer than one in STEPS: coded flat
        unit = width[:more] >> 16
        low[:more] += unit * ids[lanes * steps :].astype(np.int64)
        width[:more] = unit
        _renormalise(low[:more], width[:more], shift)
    free = np.frexp(width)[1].astype(np.int64) - 2  # so many low bits of a value in the interval may be anything
    value = (low + (np.int64(1) << free) - 1 >> free) << free
    size = (56 - free + 7) // 8
    owner = np.concatenate([np.zeros(0, np.uint16), *owners])
    words = np.concatenate([np.zeros(0, np.uint16), *sent])[np.argsort(owner, kind="stable")]
    bytes_of = 2 * np.bincount(owner, minlength=lanes)
    place = np.cumsum(bytes_of + size) - size  # behind the words of each lane
    out = np.zeros(len(words) * 2 + int(size.sum()), np.uint8)
    at = np.repeat(place - np.cumsum(bytes_of), bytes_of // 2) + 2 * np.arange(len(words))
    out[at], out[at + 1] = words >> 8, words & 255
    for k in range(7):
        some = np.flatnonzero(size > k)
        out[place[some] + k] = (value[some] >> (48 - 8 * k)) & 255
    lengths = zlib.compress((bytes_of + size).astype("<u2").tobytes(), 9)
    return b"".join([struct.pack("<I", len(lengths)), lengths, out])


def decode_block(raw: bytes, n: int) -> np.ndarray:
    lanes, steps, more = _shape(n)
    (size,) = struct.unpack_from("<I", raw)
    lengths = np.frombuffer(zlib.decompress(raw[4 : 4 + size]), "<u2").astype(np.int64)
    data = np.concatenate([np.frombuffer(raw, np.uint8, offset=4 + size), np.zeros(16, np.uint8)]).astype(np.int64)
    if len(lengths) != lanes or lengths.sum() + 16 != len(data):
        raise ValueError("a block's lanes don't fit its number of ids")
    place = np.cumsum(lengths) - lengths
    code = np.zeros(lanes, np.int64)
    for k in range(7):
        code = code << 8 | data.take(np.minimum(place + k, len(data) - 1))
    place += 7
    data = (data[:-1] << 8 | data[1:]).astype(np.uint16)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)

    def shift(some: np.ndarray, _: np.ndarray) -> None:
        at = place[some]
        code[some] = ((code[some] << 16) & _MASK) | data.take(at, mode="clip")
        place[some] = at + 2

    mix, grid, lane = _Mix(), np.zeros((steps, lanes), np.int64), np.arange(lanes)
    for at, until in _stretches(steps):
        # Entries of all distributions in a row: those of order 2 by context, of order 1 by context, of order 0, flat ones.
        seen = grid[:at]
        n0 = np.bincount(seen.reshape(-1), minlength=_IDS)
        have0 = np.flatnonzero(n0)
        none = np.zeros(0, np.int64)
        n1 = n2 = next2 = symbols1 = symbols2 = none
        after_one, after_two = np.zeros(_IDS + 1, np.int64), np.zeros(1, np.int64)
        sure1, sure2, pair = np.zeros(_IDS, np.int64), np.zeros(1, np.int64), np.zeros(lanes, np.int64)
        if at > 1:
            pairs, keys, n1, _ = _ranked((seen[:-1] << 16 | seen[1:]).reshape(-1))
            symbols1, after_one = keys & 0xFFFF, _begins(keys >> 16, _IDS)
            pairs = pairs.reshape(-1, lanes)
            triples, keys, n2, where = _ranked((pairs[:-1].astype(np.int64) << 16 | seen[2:]).reshape(-1))
            symbols2, after_two = keys & 0xFFFF, _begins(keys >> 16, len(n1))
            next2, pair = pairs[1:].reshape(-1)[where], pairs[-1]
            sure1, sure2 = 4 * _known(n1, after_one)[2], np.append(4 * _SURE * _known(n2, after_two)[2], 0)
        contexts = len(n1)
        counts = np.concatenate([n2, n1, n0[have0], np.ones(_IDS, np.int64)])
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        owner = np.arange(len(counts), dtype=np.int32).repeat(counts)
        symbols = np.concatenate([symbols2, symbols1, have0, np.arange(_IDS)])
        follows = np.concatenate([next2, np.arange(contexts), np.full(len(have0) + _IDS, contexts)])
        # Nodes: contexts of order 2 and none, contexts of order 1, order 0, flat.
        node_from = np.concatenate([after_two[:-1], [0], len(n2) + after_one[:-1], [len(n2) + contexts, len(n2) + contexts + len(have0)]])
        node_until = np.concatenate([after_two[1:], [0], len(n2) + after_one[1:], [len(n2) + contexts + len(have0), len(counts)]])
        # What is read together stands together. No sum of counts is above three ids of a block and the flat ones.
        nodes = np.stack([np.maximum(sums[node_until] - sums[node_from], 1), sums[node_from]], 1, dtype=np.int32, casting="unsafe")
        entries = np.stack([sums[:-1], counts, symbols, follows], 1, dtype=np.int32, casting="unsafe")
        last = grid[at - 1] if at else np.zeros(lanes, np.int64)
        chosen = np.zeros((until - at, lanes), np.int64)
        node_of = np.empty((4, lanes), np.int64)  # by the choice
        node_of[2], node_of[3] = contexts + 1 + _IDS, contexts + 2 + _IDS
        for t in range(at, until):
            context = chosen[t - at]
            if at > 1:
                np.add(sure1.take(last), sure2.take(pair), out=context)
            unit = width >> _SHARE_BITS
            above = code - low
            choice = (above >= unit * mix.ends[0].take(context)).view(np.int8)
            choice = choice + (above >= unit * mix.ends[1].take(context)).view(np.int8)
            choice += (above >= unit * mix.ends[2].take(context)).view(np.int8)
            context += choice
            node_of[0] = pair
            np.add(last, contexts + 1, out=node_of[1])
            row = nodes.take(node_of.reshape(-1).take(choice * np.int64(lanes) + lane), 0, mode="clip")
            of, own, begin = row[:, 0].astype(np.int64), row[:, 1].astype(np.int64), mix.flat_starts.take(context)
            part = unit * mix.flat_share.take(context)
            part //= of
            begin *= unit
            above -= begin
            above //= part
            of -= 1
            np.minimum(above, of, out=above)
            above += own
            row = entries.take(owner.take(above, mode="clip"), 0, mode="clip").astype(np.int64)
            before, last, pair = row[:, 0] - own, row[:, 2], row[:, 3]
            before *= part
            low += begin
            low += before
            np.multiply(part, row[:, 1], out=width)
            _renormalise(low, width, shift)
            grid[t] = last
        mix.learn(chosen.reshape(-1))
    out = np.empty(n, np.uint32)
    out[: lanes * steps] = grid.astype(np.uint16).T.reshape(-1)
    if more:
        out[lanes * steps :] = (code[:more] - low[:more]) // (width[:more] >> 16)
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    return [encode_block(ids[low : low + BLOCK_IDS]) for low in range(0, len(ids), BLOCK_IDS)]


def decode_blocks(blocks: list[bytes], n_ids: int) -> np.ndarray:
    if len(blocks) != -(-n_ids // BLOCK_IDS):
        raise ValueError("a frame's number of blocks doesn't fit its number of ids")
    return np.concatenate([np.zeros(0, np.uint32), *(decode_block(b, min(BLOCK_IDS, n_ids - k * BLOCK_IDS)) for k, b in enumerate(blocks))])


def pack_frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids need 16 bits")
    blocks = encode_blocks(ids)
    sums = [(zlib.crc32(block), zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u4").tobytes())) for k, block in enumerate(blocks)]
    index = zlib.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    head = struct.pack("<4sIQII", MAGIC, len(doc_ids), len(ids), len(blocks), len(index))
    return b"".join([head, struct.pack("<I", zlib.crc32(index)), index, np.array([len(b) for b in blocks], "<u4").tobytes(), np.array(sums, "<u4").tobytes(), *blocks])


def unpack_frame(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids; a damaged frame is an error."""
    magic, n_docs, n_ids, n_blocks, size = struct.unpack_from("<4sIQII", raw)
    at = struct.calcsize("<4sIQII")
    index = raw[at + 4 : at + 4 + size]
    if magic != MAGIC or zlib.crc32(index) != struct.unpack_from("<I", raw, at)[0]:
        raise ValueError("this is no token frame, or its index is damaged")
    at += 4 + size
    index = zlib.decompress(index)
    null, docs = np.frombuffer(index, np.uint8, n_docs), np.frombuffer(index, "<i8", n_docs, n_docs)
    lengths = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    sizes, sums = np.frombuffer(raw, "<u4", n_blocks, at).astype(np.int64), np.frombuffer(raw, "<u4", 2 * n_blocks, at + 4 * n_blocks).reshape(-1, 2)
    at += 12 * n_blocks
    cuts = np.concatenate([[0], np.cumsum(sizes)]) + at
    blocks = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    for k, block in enumerate(blocks):
        if zlib.crc32(block) != sums[k, 0]:
            raise ValueError(f"block {k} of a token frame is damaged")
    ids = decode_blocks(blocks, n_ids)
    for k in range(n_blocks):
        if zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].tobytes()) != sums[k, 1]:
            raise ValueError(f"block {k} of a token frame doesn't hold what was written")
    return [None if z else int(d) for z, d in zip(null, docs, strict=True)], lengths, ids


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, frame_ids: int = FRAME_IDS) -> None:
    """Encodes every document into frame files under ``path``."""
    source, end = tokenizer_path or default_path(), np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = {"frame": 0, "before": 0}
        doc_ids: list = []
        held: list[bytes] = []

        def frame() -> pa.RecordBatch:
            lengths, ids = [len(h) // 4 for h in held], np.frombuffer(b"".join(held), "<u4")
            values = (part, state["frame"], state["before"], len(ids), len(doc_ids), pack_frame(doc_ids, lengths, ids))
            state["frame"] += 1
            state["before"] += len(ids)
            doc_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=[x.split()[0] for x in FRAME_SCHEMA.split(", ")])

        size = 0
        with tokenizer(source) as known:
            for rows in batches:
                for doc_id, ids in zip(rows["doc_id"].to_pylist(), known.encode(rows["text"].to_pylist()), strict=True):
                    more = len(ids) // 4 + 1
                    if doc_ids and size + more > frame_ids:
                        yield frame()
                        size = 0
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    size += more
        if doc_ids:
            yield frame()

    spark = docs.sparkSession
    place = ["doc_id", "of_text"]  # both, so that rows under one id, or without one, are spread too
    ordered = id_and_text(docs).withColumn("of_text", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), *place).sortWithinPartitions(*place)
    map_arrow(ordered.select("doc_id", "text"), write, FRAME_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of the document's ids with the end id; left out without ``with_ids``), ids_crc32:
    decoded from the files."""
    frames = spark.read.parquet(path)
    # One number for each part: as many as the writer had partitions.
    sizes = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, ids_before, payload in zip(rows["part"].to_pylist(), rows["ids_before"].to_pylist(), rows["payload"], strict=True):
                doc_ids, lengths, ids = unpack_frame(payload.as_py())
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                for low in range(0, len(doc_ids), 500):
                    some = slice(low, min(low + 500, len(doc_ids)))
                    own = cuts[some.start : some.stop + 1]
                    columns = {
                        "doc_id": pa.array(doc_ids[some], pa.int64()),
                        "start": pa.array(own[:-1] + (before[part] + ids_before), pa.int64()),
                        "n_tokens": pa.array(lengths[some], pa.int64()),
                        "ids": pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(ids[own[0] : own[-1]], pa.int32())) if with_ids else None,
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own.tolist(), own[1:].tolist())], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if v is not None})

    return map_arrow(frames.select("part", "ids_before", "payload"), read, "doc_id long, start long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_crc32 long")
