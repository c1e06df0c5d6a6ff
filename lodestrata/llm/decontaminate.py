"""Benchmark decontamination by spaced seeds.

A seed reads some of WINDOW consecutive words and ignores the others (fixed masks), so a window still hits where a
substituted word falls on an ignored place. Each two places of a window are ignored together by one of the masks, and
so are any three of five neighbours by one of the first two at some offset, so an item of WINDOW words or more always
hits where LEAST_SHARE of it is right. Shorter items are looked up by a hash of the whole. Hashes of all windows of all
benchmark items are joined with those of the documents; a filter sized by the benchmark lets documents send only windows
that may hit (what passes it wrongly fails the join). Items that share a hash are gathered under it once, and a hash that
very many hits have is joined by a broadcast whose size is bounded, so no hash's hits meet in a task.

Windows of a document that stand close together send their surroundings once, as word hashes, and each hit's alignment is
verified there: the best stretch, where a match counts one and a substitution takes two, must hold LEAST_MATCHES matching
words (or LEAST_SHARE of a shorter item), or else the item's whole length must hold LEAST_SHARE of its words, wherever the
others stand; an item shorter than WINDOW must be there word for word.

Defined results: null texts are empty; items without words match nothing; rows with a null doc_id
or item_id are never reported, and such documents are kept; rows that share a doc_id are one document in the report, while
each row is kept or dropped by its own text; empty tables give an empty table; other columns are ignored by the report and stay in what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, map_arrow
from .filters import HashFilter, hash_filter
from .rows import parted
from .textkit import Words, mix, runs, words

WINDOW = 10
#: Places of a window that a seed reads (1) and ignores (0).
MASKS = ("1110001011", "1101000111", "0011110011", "1110110100", "0100111101", "1001111010", "1011001101", "0111001110", "1010111001")
LEAST_MATCHES, LEAST_SHARE, SUBSTITUTION = 13, 0.8, 2
#: Words of surroundings on either side of a group of hits.
REACH = 80
#: Bits of the filter for each hash of the benchmark: every window of a document is tested nine times.
FILTER_BITS = 256
#: Hashes that are joined by broadcast: at most so many can each have one in so many of all hits. One that has fewer hits
#: than HOT_LEAST never is.
HOT_HASHES, HOT_LEAST = 1 << 12, 1000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def seeds(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(masks, windows) hashes, and the first word of each window."""
    n = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
    at = np.arange(n.sum()) + np.repeat(w.first[:-1] - (np.cumsum(n) - n), n)
    out = np.zeros((len(MASKS), len(at)), np.uint64)
    for k in range(WINDOW):
        part = w.hash[at + k] * _FACTORS[k]
        for m, mask in enumerate(MASKS):
            if mask[k] == "1":
                out[m] += part
    return mix(out + np.arange(1, len(MASKS) + 1, dtype=np.uint64)[:, None]), at


def whole_runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, fewer than WINDOW, and the first word of each."""
    hashed, first = runs(w, size)
    at = np.arange(len(hashed)) + np.repeat(w.first[:-1] - first[:-1], np.diff(first))
    return mix(hashed + np.uint64(len(MASKS) + size)), at


def _clean(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("id").isNotNull())


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, at."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows["id"].to_numpy()
            for w in words(rows["text"]):
                hashed, at = seeds(w)
                value, place = hashed.reshape(-1), np.tile(at, len(MASKS))
                for size in range(1, WINDOW):
                    hashed, at = whole_runs(w, size)
                    whole = np.diff(w.first)[w.text_of_word()[at]] == size
                    value, place = np.concatenate([value, hashed[whole]]), np.concatenate([place, at[whole]])
                text = w.text_of_word()[place]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[text + w.rows.start]), pa.array((place - w.first[text]).astype(np.int32))], names=["hash", "item_id", "at"])

    return map_arrow(_clean(benchmark, "item_id"), emit, "hash long, item_id long, at int")


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words (64-bit word hashes as bytes)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for w in words(rows["text"]):
                yield pa.RecordBatch.from_arrays([rows["id"][w.rows], pa.array([w.hash[a:b].tobytes() for a, b in zip(w.first, w.first[1:])], pa.binary())], names=["item_id", "item_words"])

    return map_arrow(_clean(benchmark, "item_id"), emit, "item_id long, item_words binary").dropDuplicates()


def short_sizes(benchmark: DataFrame) -> list[int]:
    """Numbers of words, below WINDOW, that items have."""
    sizes = benchmark_words(benchmark).select((F.length("item_words") / 8).cast("int").alias("n")).where(F.col("n").between(1, WINDOW - 1)).distinct()
    return sorted(r["n"] for r in sizes.collect())


def document_hits(docs: DataFrame, known: HashFilter, sizes: list[int]) -> DataFrame:
    """Rows of two kinds. Hits: id, group, hash, at. Surroundings: id, group, from, context (word hashes as bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            ids = rows["id"].to_numpy()
            for w in words(rows["text"]):
                hashed, at = seeds(w)
                mask, window = np.nonzero(known.may_hold(hashed))
                found, value = at[window], hashed[mask, window]
                for size in sizes:
                    hashed, at = whole_runs(w, size)
                    held = np.flatnonzero(known.may_hold(hashed))
                    found, value = np.concatenate([found, at[held]]), np.concatenate([value, hashed[held]])
                if not len(found):
                    continue
                order = np.argsort(found, kind="stable")
                found, value = found[order], value[order]
                text = w.text_of_word()[found]
                opens = np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] - found[:-1] > REACH)])
                group = np.cumsum(opens) - 1
                starts = np.flatnonzero(opens)
                last = np.append(starts[1:], len(found)) - 1
                low = np.maximum(found[starts] - REACH, w.first[text[starts]])
                high = np.minimum(found[last] + WINDOW + REACH, w.first[text[starts] + 1])
                name = low - w.first[text[starts]]  # a document's groups have different ones
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text + w.rows.start]), pa.array(name[group].astype(np.int32)), pa.array(value.view(np.int64)), pa.array((found - low[group]).astype(np.int32)), pa.nulls(n, pa.binary())],
                    names=["id", "group", "hash", "at", "context"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[text[starts] + w.rows.start]), pa.array(name.astype(np.int32)), pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.int32()), pa.array([w.hash[a:b].tobytes() for a, b in zip(low, high)], pa.binary())],
                    names=["id", "group", "hash", "at", "context"],
                )

    return map_arrow(_clean(docs, "doc_id"), emit, "id long, group int, hash long, at int, context binary")


def best_stretch(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Matches, length and first word in the text of the best stretch with item[i] beside text[i + shift]."""
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    same = text[low + shift : high + shift] == item[low:high]
    if not len(same):
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    gains = sums[1:] - np.minimum.accumulate(sums[:-1])
    end = int(gains.argmax()) + 1
    start = int(sums[:end].argmin())
    return int(same[start:end].sum()), end - start, low + shift + start


def whole_item(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Matches of all of the item with item[i] beside text[i + shift], and length and first word in the text from the first to the last of them."""
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    same = np.flatnonzero(text[low + shift : high + shift] == item[low:high])
    return (len(same), int(same[-1] - same[0]) + 1, low + shift + int(same[0])) if len(same) else (0, 0, 0)


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Matches, length and first word of what is reported of an alignment; None where it isn't enough."""
    share = len(item) if len(item) < WINDOW else int(np.ceil(LEAST_SHARE * len(item)))
    for overlap, least in ((best_stretch, min(LEAST_MATCHES, share)), (whole_item, share)):
        got = overlap(text, item, shift)
        if got[0] >= max(1, least):
            return got
    return None


def alignments(sent: DataFrame, index: DataFrame) -> DataFrame:
    """id, group, item_id, shift of all hits, each alignment once."""
    hits = sent.where(F.col("hash").isNotNull()).select("id", "group", "hash", F.col("at").alias("text_at"))
    # Each hash has its items in one row, so hits are as many as windows; one text of a hash that a third of all documents
    # hold is joined where it stands: hashes with one in HOT_HASHES of all hits are HOT_HASHES at most.
    items = durable(index.distinct().groupBy("hash").agg(F.collect_list(F.struct("item_id", "at")).alias("items")))
    counted = durable(hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).join(items.select("hash"), "hash", "left_semi"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = counted.where(F.col("n") >= max(HOT_LEAST, -(-total // HOT_HASHES))).select(F.col("hash").alias("hot"))
    told = hits.join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left")
    often = told.where("hot IS NOT NULL").join(F.broadcast(items.join(hot, F.col("hash") == F.col("hot"), "left_semi")), "hash")
    seldom = told.where("hot IS NULL").join(items, "hash")
    found = often.select("id", "group", "text_at", "items").unionAll(seldom.select("id", "group", "text_at", "items"))
    one = found.select("id", "group", "text_at", F.explode("items").alias("item"))
    return one.select("id", "group", F.col("item.item_id").alias("item_id"), (F.col("text_at") - F.col("item.at")).alias("shift")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matches, n_words, first_word: the best verified overlap of each document and item."""
    index = durable(benchmark_seeds(benchmark))
    sent = durable(document_hits(docs, hash_filter(index, bits_per_hash=FILTER_BITS), short_sizes(benchmark)))
    # What aligns the same way in the same group is verified once, however many windows hit.
    full = alignments(sent, index).join(sent.where(F.col("hash").isNull()).select("id", "group", "context"), ["id", "group"]).join(benchmark_words(benchmark), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                text, item = np.frombuffer(r["context"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
                if (got := best_overlap(text, item, r["shift"])) is not None:
                    out.append((r["id"], r["item_id"], got[0], got[1], r["group"] + got[2]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "n_matches", "n_words", "first_word"])

    passed = map_arrow(full.select("id", "group", "item_id", "shift", "context", "item_words"), verify, "doc_id long, item_id long, n_matches int, n_words int, first_word int")
    best = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matches", F.negative("n_words").alias("w"), F.negative("first_word").alias("f"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_matches").alias("n_matches"), F.negative("b.w").alias("n_words"), F.negative("b.f").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns as they are. Of rows that share a doc_id those go
    whose own text holds one: a row is named by a hash of both. Only rows that may go are compared; the others aren't shuffled."""
    name = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    gone = durable(contaminated(docs.select(name.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__row")).distinct())
    maybe, others = parted(docs.withColumn("__row", name), "__row", gone)
    return maybe.join(gone, "__row", "left_anti").drop("__row").unionAll(others.drop("__row"))
