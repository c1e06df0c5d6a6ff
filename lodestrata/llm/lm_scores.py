"""Stupid-backoff scores of every document by the word bigrams of all the others.

S(w | v) = c(v w) / c(v) where another document has the bigram, else BACKOFF * c(w) / N; counts leave the scored
document out, and a count that is left empty is taken as one. The score of a document is the mean of ln S over its
bigrams.

Every count is of the word or bigram itself. Words with at least one in TABLE_WORDS of all occurrences are counted by
one aggregation into a table, which has at most TABLE_WORDS rows whatever the input and may be broadcast; and so are the
bigrams that are as frequent: blocks report theirs, the candidates are counted exactly, and a text's occurrences of them
are scored where the text is read, so no very frequent bigram's occurrences meet in a task. The count
table of the other bigrams of two such words is partitioned by the bigram's hash: each partition gets all occurrences of its
bigrams, packed by source batch (40 bits of the hash, what a hit is worth beyond its backoff, grouped by document),
counts them there, joins the counts with the occurrences and sends each document's sum on, packed, to where it is
totalled. The other words are counted the same way: what holds such a word goes to the partition of the word's hash
(of both words' hashes, where both are such), which so gets all occurrences of the word and of its bigrams, counts
both and adds what the word's count is worth. One shuffle carries the tables and the exploded n-grams; sums are
integers of 1/1024, so they don't depend on the order of rows.

Defined results: texts with fewer than two words, empty or null, have no bigrams and a null score; rows with a null
doc_id are scored as documents of their own; rows that share a doc_id are one document in their sums and one row in
the result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable, id_and_text, map_arrow, shuffle_partitions
from .textkit import Words, mix, runs, words

BACKOFF = 0.4
#: Words are told apart by their whole hash.
UNIGRAM_CLASSES = 1 << 64
#: Bound of the table of frequent words; the others are counted in partitions.
TABLE_WORDS = 1 << 20
#: Words that a task counts before it sends counts on.
CHUNK_WORDS = 1 << 22
#: Bigrams of a partition, about: bounds the memory of a task.
PARTITION_BIGRAMS = 4_000_000
#: Bytes of text that are packed together.
PACK_BYTES = 3 << 20
UNIT = 1024
#: Stands for a null doc_id in packed tables.
NO_ID = -(1 << 62)
_LOW = np.uint64((1 << 40) - 1)
#: What a rare word is in a row: the last word of a text, the first of a bigram, the second beside a rare one, the second beside a frequent one.
END, HEAD, TAIL, TAIL_ALONE = range(4)


def _places(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Where each hash is in the sorted table; its length for those that aren't there."""
    if not len(table):
        return np.zeros(len(hashed), np.int64)
    at = np.searchsorted(table, hashed)
    return np.where(table[np.minimum(at, len(table) - 1)] == hashed, at, len(table))


def unigram_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the frequent words, sorted, their occurrences in the whole table, and those of all words."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(w.hash) for rows in batches for w in words(rows["text"]))], pa.int64())], names=["n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for low in range(0, len(keys), 1 << 16):
                some = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["hash", "n"])

        held, n_held = [np.zeros(0, np.uint64)], 0
        for rows in batches:
            for w in words(rows["text"]):
                held.append(w.hash)
                n_held += len(w.hash)
                if n_held >= CHUNK_WORDS:
                    yield from counted()
                    held, n_held = [np.zeros(0, np.uint64)], 0
        yield from counted()

    texts = id_and_text(docs).select("text")
    n_all = map_arrow(texts, size, "n long").agg(F.sum("n")).first()[0] or 0
    often = map_arrow(texts, count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= -(-n_all // TABLE_WORDS)).toArrow()
    table = often["hash"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(table)
    return table[order], often["n"].to_numpy().astype(np.int64)[order], n_all


def frequent_bigrams(docs: DataFrame, n_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and occurrences of bigrams with at least one in TABLE_WORDS of all; TABLE_WORDS of them at most.

    A block reports the bigrams that are so frequent in it; which of them are taken is decided by the reports alone, and
    what is taken is counted in all texts."""
    least = max(1, -(-n_all // TABLE_WORDS))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reported() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= max(2, -(-n_held // TABLE_WORDS))
            return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["hash", "n"])

        held, n_held = [np.zeros(0, np.uint64)], 0
        for rows in batches:
            for w in words(rows["text"]):
                held.append(runs(w, 2)[0])
                n_held += len(held[-1])
                if n_held >= CHUNK_WORDS:
                    yield reported()
                    held, n_held = [np.zeros(0, np.uint64)], 0
        yield reported()

    texts = id_and_text(docs).select("text")
    likely = map_arrow(texts, report, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash").toArrow()
    table = np.sort(likely["hash"].to_numpy().astype(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        n = np.zeros(len(table) + 1, np.int64)
        for rows in batches:
            for w in words(rows["text"]):
                n += np.bincount(_places(table, runs(w, 2)[0]), minlength=len(n))
        own = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["place", "n"])

    exact = map_arrow(texts, count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow() if len(table) else None
    counts = np.zeros(len(table), np.int64)
    if exact is not None:
        counts[exact["place"].to_numpy()] = exact["n"].to_numpy()
    return table, counts


def _units(x: np.ndarray) -> np.ndarray:
    return np.round(np.log(x) * UNIT).astype(np.int64)


def _grouped(target: np.ndarray, text: np.ndarray, whose: np.ndarray, columns: list[np.ndarray], partitions: int, kind: int) -> Iterator[tuple[int, bytes]]:
    """For each target its rows in one payload: kind, numbers of documents and rows, the documents and their numbers of rows, the columns."""
    order = np.lexsort((text, target))
    cuts = np.searchsorted(target[order], np.arange(partitions + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        some = order[cuts[p] : cuts[p + 1]]
        t = text[some]
        opens = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        number = np.diff(np.append(opens, len(t)))
        ids = whose[t[opens]]
        null = np.isnan(ids) if ids.dtype.kind == "f" else np.zeros(len(ids), bool)
        head = struct.pack("<III", kind, len(opens), len(t))
        yield p, b"".join([head, np.where(null, NO_ID, np.nan_to_num(ids)).astype("<i8").tobytes(), number.astype("<u4").tobytes(), *(c[some].tobytes() for c in columns)])


def _halves(hashed: np.ndarray) -> list[np.ndarray]:
    low = hashed & _LOW
    return [(low & np.uint64(0xFFFFFFFF)).astype("<u4"), (low >> np.uint64(32)).astype("u1")]


def packed(docs: DataFrame, unigrams: tuple[np.ndarray, np.ndarray, int], bigrams: tuple[np.ndarray, np.ndarray], partitions: int) -> DataFrame:
    """Rows of two kinds: ``payload`` has the occurrences that partition ``target`` gets from one batch; (doc_id, n, hits, base)
    has what a document scores if nothing else hits than its frequent bigrams."""
    shared = docs.sparkSession.sparkContext.broadcast((*unigrams, *bigrams))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, n_all, table2, counts2 = shared.value
        counts, n_all = np.append(counts, 0), max(2, n_all)
        for rows in batches:
            ids = rows["doc_id"].to_numpy(zero_copy_only=False)
            for w in words(rows["text"], PACK_BYTES):
                hashed, first = runs(w, 2)
                sizes = np.diff(first)
                text = np.repeat(np.arange(len(sizes)), sizes)
                n_words = np.diff(w.first)
                place = _places(table, w.hash)
                rare = place == len(table)
                # occurrences of the word in the document itself
                keys, back, own_n = np.unique(w.text_of_word() * (len(table) + 1) + place, return_inverse=True, return_counts=True)
                worth = np.where(rare, 0, _units(np.maximum(counts[place] - own_n[back], 1)))  # a rare word's is added where it is counted
                at = np.arange(len(text)) + np.repeat(w.first[:-1] - first[:-1], sizes)
                missed = _units(BACKOFF / np.maximum(n_all - n_words[text], 1)) + worth[at + 1]
                beyond = np.clip(-worth[at] - missed, -32768, 32767).astype("<i2")  # a hit adds this and ln of its count
                base = np.bincount(text, missed, len(sizes)).astype(np.int64)
                # frequent bigrams are settled here: their counts without the document's own
                place2 = _places(table2, hashed)
                settled = (place2 < len(table2)) & ~rare[at] & ~rare[at + 1]
                some = np.flatnonzero(settled)
                _, back2, own2 = np.unique(text[some] * (len(table2) + 1) + place2[some], return_inverse=True, return_counts=True)
                others = counts2[place2[some]] - own2[back2]
                hit = others > 0
                some, others = some[hit], others[hit]
                hits = np.bincount(text[some], minlength=len(sizes)).astype(np.int64)
                base += np.bincount(text[some], _units(others) + (-worth[at] - missed)[some], len(sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(len(sizes)) % partitions).astype(np.int32)), pa.array(ids[w.rows].astype(np.float64) if ids.dtype == object else ids[w.rows], pa.int64(), from_pandas=True), pa.array(sizes), pa.array(hits), pa.array(base), pa.nulls(len(sizes), pa.binary())],
                    names=["target", "doc_id", "n", "hits", "base", "payload"],
                )
                known = ids[w.rows].astype(np.float64) if ids.dtype.kind == "f" else ids[w.rows]
                of = lambda h: ((h >> np.uint64(40)) % np.uint64(partitions)).astype(np.int64)
                plain = np.flatnonzero(~rare[at] & ~rare[at + 1] & ~settled)
                out = list(_grouped(of(hashed[plain]), text[plain], known, [*_halves(hashed[plain]), beyond[plain]], partitions, 0))
                heads, tails = np.flatnonzero(rare[at]), np.flatnonzero(rare[at + 1])
                ends = w.first[1:][n_words > 0] - 1
                ends = ends[rare[ends]]
                role = np.concatenate([np.full(len(heads), HEAD), np.where(rare[at[tails]], TAIL, TAIL_ALONE), np.full(len(ends), END)]).astype("u1")
                word = w.hash[np.concatenate([at[heads], at[tails] + 1, ends])]
                bigram = np.concatenate([hashed[heads], hashed[tails], np.zeros(len(ends), np.uint64)])
                over = np.concatenate([beyond[heads], beyond[tails], np.zeros(len(ends), "<i2")]).astype("<i2")
                where = np.concatenate([text[heads], text[tails], w.text_of_word()[ends]])
                out += _grouped(of(word), where, known, [*_halves(bigram), over, *_halves(word), role], partitions, 1)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), *(pa.nulls(len(out), pa.int64()) for _ in range(4)), pa.array([raw for _, raw in out], pa.binary())], names=["target", "doc_id", "n", "hits", "base", "payload"])

    return map_arrow(id_and_text(docs), pack, "target int, doc_id long, n long, hits long, base long, payload binary")


def _unpack(raw: bytes) -> tuple[int, tuple[np.ndarray, ...]]:
    """The payload's kind, and documents, bigrams, what a hit is worth and, of kind 1, the rare words and their roles."""
    kind, n_docs, n = struct.unpack_from("<III", raw)
    at = 12
    docs = np.repeat(np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs))
    at += 12 * n_docs

    def whole(at: int) -> np.ndarray:
        return np.frombuffer(raw, "<u4", n, at).astype(np.uint64) | (np.frombuffer(raw, "u1", n, at + 4 * n).astype(np.uint64) << np.uint64(32))

    out = docs, whole(at), np.frombuffer(raw, "<i2", n, at + 5 * n)
    return kind, out if kind == 0 else (*out, whole(at + 7 * n), np.frombuffer(raw, "u1", n, at + 12 * n))


def partition_sums(occurrences: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, hits and their worth in units, from all occurrences of a partition's bigrams."""
    docs, bigram, beyond = (np.concatenate(c) for c in zip(*occurrences, strict=True))
    order = np.lexsort((docs, bigram))
    docs, bigram, beyond = docs[order], bigram[order], beyond[order]
    new = np.concatenate([[True], bigram[1:] != bigram[:-1]])
    start = np.flatnonzero(new)
    total = np.repeat(np.diff(np.append(start, len(bigram))), np.diff(np.append(start, len(bigram))))
    mine = np.flatnonzero(new | np.concatenate([[True], docs[1:] != docs[:-1]]))
    own = np.repeat(np.diff(np.append(mine, len(bigram))), np.diff(np.append(mine, len(bigram))))
    others = total - own
    hit = others > 0
    worth = _units(others[hit]) + beyond[hit]
    who, back = np.unique(docs[hit], return_inverse=True)
    return who, np.bincount(back, minlength=len(who)).astype(np.int64), np.bincount(back, worth, len(who)).astype(np.int64)


def _totals(docs: np.ndarray, keys: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """For each row the sum of ``counts`` over the rows of its keys that other documents have."""
    if not len(docs):
        return np.zeros(0, np.int64)
    order = np.lexsort((docs, *keys))
    new = np.zeros(len(docs), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    mine = new.copy()
    mine[1:] |= docs[order][1:] != docs[order][:-1]
    total, own = (np.repeat(np.add.reduceat(counts[order], opens), np.diff(np.append(opens, len(docs)))) for opens in map(np.flatnonzero, (new, mine)))
    out = np.empty(len(docs), np.int64)
    out[order] = total - own
    return out


def rare_sums(occurrences: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, hits and worth in units, from all that holds a partition's rare words."""
    docs, bigram, beyond, word, role = (np.concatenate(c) for c in zip(*occurrences, strict=True))
    tail = role >= TAIL
    of_word = _units(np.maximum(_totals(docs, [word], (~tail).astype(np.int64)), 1))
    inside = role != END
    others = np.zeros(len(docs), np.int64)
    others[inside] = _totals(docs[inside], [bigram[inside], word[inside], tail[inside]], np.ones(inside.sum(), np.int64))
    hit = others > 0
    carries = hit & (role != TAIL)  # where both words are rare, the first one's partition adds what a hit is worth
    worth = np.where(carries, _units(np.maximum(others, 1)) + beyond, 0)
    worth += np.where(hit & (role == HEAD), -of_word, 0) + np.where(~hit & tail, of_word, 0)
    who, back = np.unique(docs, return_inverse=True)
    return who, np.bincount(back, carries, len(who)).astype(np.int64), np.bincount(back, worth, len(who)).astype(np.int64)


def _sums_packed(docs: np.ndarray, n: np.ndarray, hits: np.ndarray, units: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Sums of documents in one payload for each partition that totals them."""
    target = (mix(docs.view(np.uint64)) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(partitions + 1))
    table = np.stack([docs, n, hits, units], 1).astype("<i8")[order]
    own = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([table[cuts[p] : cuts[p + 1]].tobytes() for p in own], pa.binary())], names=["target", "payload"])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bigrams, n_hits, score."""
    spark = docs.sparkSession
    unigrams = unigram_counts(docs)
    bigrams = frequent_bigrams(docs, unigrams[2])
    partitions = max(shuffle_partitions(spark), -(-unigrams[2] // PARTITION_BIGRAMS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for rows in batches:
            for target, raw in zip(rows["target"].to_pylist(), rows["payload"], strict=True):
                if raw.is_valid:
                    kind, part = _unpack(raw.as_py())
                    held.setdefault((target, kind), []).append(part)
            own = rows.filter(pa.compute.is_null(rows["payload"]))
            if own.num_rows:
                names = pa.compute.fill_null(own["doc_id"], NO_ID).to_numpy()
                yield _sums_packed(names, own["n"].to_numpy(), own["hits"].to_numpy(), own["base"].to_numpy(), partitions)
        for key in list(held):
            who, hits, worth = (rare_sums if key[1] else partition_sums)(held.pop(key))
            yield _sums_packed(who, np.zeros(len(who), np.int64), hits, worth, partitions)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merge() -> np.ndarray:
            table = np.concatenate(held)
            names, back = np.unique(table[:, 0], return_inverse=True)
            out = np.zeros((len(names), 4), np.int64)
            out[:, 0] = names
            np.add.at(out[:, 1:], back, table[:, 1:])
            return out

        held, size = [np.zeros((0, 4), np.int64)], 0
        for rows in batches:
            for raw in rows["payload"]:
                held.append(np.frombuffer(raw.as_py(), "<i8").reshape(-1, 4))
                size += len(held[-1])
                if size > 1 << 20:  # what is held stays near the number of documents
                    held = [merge()]
                    size = 0
        out = merge()
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0], mask=out[:, 0] == NO_ID), *(pa.array(out[:, k].copy()) for k in (1, 2, 3))], names=["doc_id", "n_bigrams", "n_hits", "units"])

    sums = map_arrow(packed(docs, unigrams, bigrams, partitions).repartitionById(partitions, F.col("target")), join, "target int, payload binary")
    summed = map_arrow(sums.repartitionById(partitions, F.col("target")), total, "doc_id long, n_bigrams long, n_hits long, units long")
    return summed.select("doc_id", "n_bigrams", "n_hits", F.when(F.col("n_bigrams") > 0, F.col("units") / (UNIT * F.col("n_bigrams"))).alias("score"))


def score_orders(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, n_scored, hits (words scored by each order, from 1), score: stupid backoff of any order, in DataFrame operations.

    S(w | context) = c(context w) / c(context) for the longest context of up to ``order`` - 1 words with which another
    document has w, times BACKOFF for each that was given up; at last c(w) / N. Counts leave the scored document out, and one
    that is left empty is taken as one. N-grams are exploded and summed for each document, their totals are a table
    partitioned by hash, and its join with the exploded n-grams, on the same key, may be split by the engine where a hash is
    frequent. For large corpora ``score_documents`` does order 2 in far less space; see the README. Rows that share a doc_id,
    or have none, are one document, as there.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = id_and_text(docs).select("doc_id", F.regexp_extract_all(lower, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w"), F.monotonically_increasing_id().alias("row"))
    split = durable(split)  # a row's number must not change when it is read again
    at = split.select("doc_id", "row", "w", F.posexplode("w").alias("place", "word"))
    grams = at.select("doc_id", "row", "place", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("place") + 1))).alias("k"), "w")
    grams = grams.select("doc_id", "row", "place", "k", F.xxhash64(F.slice("w", F.col("place") - F.col("k") + 2, F.col("k"))).alias("hash"))
    own = durable(grams.groupBy("k", "hash", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    totals = own.groupBy("k", "hash").agg(F.sum("n").alias("total"))
    others = own.join(totals, ["k", "hash"]).select("k", "hash", F.col("doc_id").alias("of"), (F.col("total") - F.col("n")).alias("c"))
    counted = grams.alias("g").join(others.alias("o"), (F.col("g.k") == F.col("o.k")) & (F.col("g.hash") == F.col("o.hash")) & F.col("doc_id").eqNullSafe(F.col("of")))
    placed = counted.groupBy("doc_id", "row", "place").agg(*(F.max(F.when(F.col("g.k") == k, F.col("c"))).alias(f"c{k}") for k in range(1, order + 1)))
    words_of = own.where("k = 1").groupBy("doc_id").agg(F.sum("n").alias("in_doc"))
    n_all = own.where("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = Window.partitionBy("doc_id", "row").orderBy("place")
    seen = placed.select("*", *(F.lag(f"c{k}").over(before).alias(f"b{k}") for k in range(1, order))).where("place > 0")
    with_size = seen.alias("s").join(words_of.alias("t"), F.col("s.doc_id").eqNullSafe(F.col("t.doc_id"))).select("s.*", "in_doc")
    # ln S from the longest order down: one that no other document has, or that the place doesn't allow, is passed over
    score = F.log(F.greatest(F.col("c1"), F.lit(1)) / F.greatest(F.lit(max(2, n_all)) - F.col("in_doc"), F.lit(1)))
    best = F.lit(1)
    for k in range(2, order + 1):
        hit = F.col(f"c{k}") > 0
        given_up = F.when(F.col("place") >= k - 1, F.lit(float(np.log(BACKOFF)))).otherwise(0.0)
        score = F.when(hit, F.log(F.col(f"c{k}") / F.greatest(F.col(f"b{k - 1}"), F.lit(1)))).otherwise(given_up + score)
        best = F.when(hit, F.lit(k)).otherwise(best)
    summed = with_size.select("doc_id", score.alias("ln"), best.alias("best")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_scored"), F.array(*(F.count(F.when(F.col("best") == k, 1)) for k in range(1, order + 1))).alias("hits"), F.avg("ln").alias("score"))
    everyone = split.select(F.col("doc_id").alias("id")).distinct()
    none = F.array(*[F.lit(0).cast("long")] * order)
    out = everyone.join(summed, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("hits", none).alias("hits"), "score")
