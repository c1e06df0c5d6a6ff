"""Substring deduplication by sliding spans of sentences.

A sentence ends with a word that ends in . ! or ?, or at a line break. Long ones are split into units where the text
itself says so: before a word whose hash is the least of NEAR words to either side, EDGE words or more from both ends
of its sentence. So a passage is split alike wherever it stands, but for a few words at its ends; what has no such
place for UNIT_WORDS words is split there. Every run of several consecutive units (SPAN_SENTENCES at least, and as many
more as it takes to hold SPAN_WORDS words) is hashed from each unit on, or up to it where no such run ends; equal runs are found by one join over all
documents. The first occurrence, by doc_id and place, stays; the units that any other occurrence covers are removed.
Words are compared without case and white space. The counts in the result are of sentences, or of their pieces of
SENTENCE_WORDS words where they are longer: all of them, and those that lost words.

Counting is pre-aggregated by the run's hash; a filter sized by the repeated hashes then lets documents send only runs that
are repeated, and runs that a large share of all are look their first place up in a broadcast of bounded size instead of
meeting in a task. What reaches one document is bounded by its own sentences.

Defined results: null text is empty and nothing is removed; rows with a null doc_id are passed as they are; rows that
share a doc_id are one document and equal places in them one occurrence; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, id_and_text, map_arrow
from .filters import HashFilter, hash_filter
from .textkit import Words, mix, words

SPAN_SENTENCES, SPAN_WORDS, SENTENCE_WORDS = 2, 20, 16
NEAR, EDGE, UNIT_WORDS = 4, 6, 24
#: Hashes that are looked up by broadcast, at most; one that has fewer occurrences than HOT_LEAST never is.
HOT_HASHES, HOT_LEAST = 1 << 12, 1000
_Q = 0x9E3779B97F4A7C15
_Q_INVERSE = pow(_Q, -1, 1 << 64)
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _powers(q: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), q, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _sentence_starts(w: Words) -> np.ndarray:
    lines = np.cumsum(w.bytes == 10)
    ends = _STOPS[w.bytes[w.end - 1]]
    ends[:-1] |= lines[w.start[1:]] > lines[w.end[:-1] - 1]
    ends[w.first[1:][w.first[1:] > 0] - 1] = True
    return np.concatenate([[True], ends[:-1]])


def sentences(w: Words) -> np.ndarray:
    """First word of each sentence, at most SENTENCE_WORDS long."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(_sentence_starts(w))
    within = np.arange(len(w.start)) - np.repeat(begin, np.diff(np.append(begin, len(w.start))))
    return np.flatnonzero(within % SENTENCE_WORDS == 0)


def units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each unit (and the number of words at last), their hashes, and first[]: text d has units first[d]:first[d+1]."""
    n = len(w.start)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(len(w.first), np.int64)
    opens = _sentence_starts(w)
    begin = np.flatnonzero(opens)
    sizes = np.diff(np.append(begin, n))
    within = np.arange(n) - np.repeat(begin, sizes)
    at = np.flatnonzero((within >= EDGE) & (np.repeat(sizes, sizes) - within >= EDGE))
    for k in range(1, NEAR + 1):
        at = at[(w.hash[at] < w.hash[at - k]) & (w.hash[at] < w.hash[at + k])]
    opens[at] = True
    begin = np.flatnonzero(opens)
    within = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    begin = np.flatnonzero(within % UNIT_WORDS == 0)
    hashed = mix(np.add.reduceat(w.hash * _powers(_Q, UNIT_WORDS)[within % UNIT_WORDS], begin))
    return np.append(begin, n), hashed, np.searchsorted(begin, w.first)


def spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first unit (in the text) and number of units of each span."""
    begin, hashed, first = units(w)
    n = len(hashed)
    at = np.arange(n)
    until = np.maximum(at + SPAN_SENTENCES, np.searchsorted(begin, begin[:-1] + SPAN_WORDS))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fits = until <= first[1:][text] if n else np.zeros(0, bool)
    # a run that ends where none of these does, so that the last units of a passage count too
    since = np.searchsorted(begin, begin[1:] - SPAN_WORDS, "right") - 1
    since = np.minimum(since, at + 1 - SPAN_SENTENCES)
    closes = np.zeros(n + 1, bool)
    closes[until[fits]] = True
    more = np.flatnonzero((since >= first[text]) & ~closes[1:])
    at, until, text = np.concatenate([at[fits], since[more]]), np.concatenate([until[fits], more + 1]), np.concatenate([text[fits], text[more]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _powers(_Q, n), dtype=np.uint64)])
    out = mix((sums[until] - sums[at]) * _powers(_Q_INVERSE, n)[at] + (until - at).astype(np.uint64))
    return out, text, at - first[text], until - at


def span_table(docs: DataFrame, known: HashFilter | None = None) -> DataFrame:
    """hash, doc_id, at, size of every span, or of those whose hash may be known."""
    shared = docs.sparkSession.sparkContext.broadcast(known) if known else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows["doc_id"].to_numpy(zero_copy_only=False)
            for w in words(rows["text"]):
                hashed, text, at, size = spans(w)
                if shared:
                    some = np.flatnonzero(shared.value.may_hold(hashed))
                    hashed, text, at, size = hashed[some], text[some], at[some], size[some]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(ids[text + w.rows.start].astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], names=["hash", "doc_id", "at", "size"])

    return map_arrow(id_and_text(docs).where(F.col("doc_id").isNotNull()), emit, "hash long, doc_id long, at int, size int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, at, size: the units of every non-first occurrence."""
    place = F.struct("doc_id", "at")
    counted = span_table(docs).groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    known = durable(counted.where(F.col("first") != F.col("last")).select("hash", "first", "n"))
    total = known.agg(F.sum("n")).first()[0] or 0
    # Only occurrences of what is repeated are sent. A hash with one in HOT_HASHES of those, and there are HOT_HASHES such at
    # most, is looked up where it stands, and its occurrences go anywhere.
    hot = known.where(F.col("n") >= max(HOT_LEAST, -(-total // HOT_HASHES))).select(F.col("hash").alias("hot"), F.col("first").alias("hot_first"))
    some = span_table(docs, hash_filter(known.select("hash"))).join(F.broadcast(hot), F.col("hash") == F.col("hot"), "left")
    often = F.col("hot").isNotNull()
    keyed = some.withColumn("key", F.when(often, F.xxhash64("doc_id", "at")).otherwise(F.col("hash")))
    found = keyed.join(known.select(F.col("hash").alias("key"), "first"), "key", "left").withColumn("first", F.when(often, F.col("hot_first")).otherwise(F.col("first")))
    return found.where(F.col("first").isNotNull() & (F.struct("doc_id", "at") != F.col("first"))).select("doc_id", "at", "size")


def cut_sentences(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the covered (first unit, number) runs, its sentences and those that lost words."""
    raw = text.encode()
    (w,) = words(pa.array([text], pa.string()), max(1, len(raw)))
    begin, hashed, _ = units(w)
    gone = np.zeros(len(hashed) + 1, np.int64)
    for at, size in covered:  # places beyond the end are another row's of the same doc_id
        gone[min(at, len(hashed))] += 1
        gone[min(at + size, len(hashed))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    cuts = np.append(w.start[begin[:-1]], len(raw))
    kept = [raw[: cuts[0]]] + [raw[a:b] for a, b, g in zip(cuts[:-1], cuts[1:], gone, strict=True) if not g]
    opens = sentences(w)
    lost = np.add.reduceat(np.repeat(gone, np.diff(begin)).astype(np.int64), opens) if len(opens) else opens
    return b"".join(kept).decode(), len(opens), int((lost > 0).sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated sentences cut from ``text``; n_sentences and n_removed are added (null if nothing was cut)."""
    covered = repeated_spans(docs).groupBy("doc_id").agg(F.collect_set(F.struct("at", "size")).alias("__covered"))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "__covered")]
    joined = docs.select(*kept).join(covered, "doc_id", "left")
    at = joined.columns.index("text")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in joined.schema[:-1])}, n_sentences int, n_removed int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, ranges = rows.column(at).to_pylist(), rows.column(rows.num_columns - 1).to_pylist()
            out = [cut_sentences(t, [(r["at"], r["size"]) for r in c]) if c else (t, None, None) for t, c in zip(texts, ranges, strict=True)]
            columns = [rows.column(k) for k in range(rows.num_columns - 1)]
            columns[at] = pa.array([o[0] for o in out], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=[*rows.schema.names[:-1], "n_sentences", "n_removed"])

    return map_arrow(joined, cut, schema)
