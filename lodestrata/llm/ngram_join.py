"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Documents are sets of hashed word 5-grams. Equal sets are one class from the start (a 64-bit fingerprint names it), so
copies are never paired. The tokens of a set are put in one global order, rare ones first, and its prefix of
floor(n / 5) + l tokens is sent to the tokens' buckets: two sets with a Jaccard similarity of 0.8 share at least
min(l, l') tokens of their prefixes. Each document chooses l by the estimated cost of its candidates (the counts of
its prefix's tokens): expensive prefixes are made longer and must then share correspondingly more tokens before the
pair is verified on whole texts.

The order may be any that all documents share. Counts come from every document: a task reports the tokens that repeat
in one block of it; of those the FREQUENT most frequent, at most, are broadcast. It only makes buckets shorter.

No bucket is expanded into all its pairs when it is large. Buckets of up to SMALL classes give all their pairs. A
larger one first gives a star: every class with the one that has the largest share of frequent tokens, as the original
of a group of edited copies has. Verified links are joined to components, and only then it gives the pairs across
components; buckets that lie within one component, as those of a group of near copies do, give none. Links inside a
component can't change it, so no link between different components is lost. A token's places in two sets bound their
overlap (what stands before the first token in common is lost to both), which rules out most pairs unsent.

Defined results: without words (null and empty texts) the set is empty, links with nothing, and the component is the
document itself; rows with a null doc_id are returned with a null component and link with nothing; rows that share a
doc_id and a text are alike, and each row is returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, give_back, id_and_text, map_arrow, shuffle_partitions
from .components import components
from .rows import one_of_each, parted
from .textkit import mix, shingle_sets

#: Links need SHARE[0] * union <= SHARE[1] * intersection.
SHARE = (4, 5)
WORDS = 5
#: Tokens that are ordered by their counts at most (12 bytes each); a token counts from LEAST_COUNT on.
FREQUENT, LEAST_COUNT = 1 << 20, 8
#: Tokens of a block that is searched for repeated ones.
BLOCK_TOKENS = 2_000_000
#: Mean count of a prefix's tokens from which a document's prefix gets one more token; one more also for each so many
#: tokens of the prefix, where it costs next to nothing and spares the pairs that share a single token by chance.
COSTS, CHEAP, MOST_CHEAP = (4, 32, 256), 20, 3
#: Classes of a bucket that gives all its pairs, and rounds of stars before pairs across components.
SMALL, STARS = 8, 1
#: Pairs of a hub that are verified together.
CHUNK_LEAVES = 64
_SEED = np.uint64(0xA24BAED4963EE407)


def fingerprint(tokens: np.ndarray) -> np.int64:
    """Of a set; 0 for the empty one."""
    if not len(tokens):
        return np.int64(0)
    total = tokens.sum(dtype=np.uint64, keepdims=True) * _SEED ^ np.bitwise_xor.reduce(mix(tokens)) ^ np.uint64(len(tokens))
    return mix(total | np.uint64(1)).view(np.int64)[0]


def least_overlap(n: int) -> int:
    """What a set of n must share with any set it links with."""
    return -(-SHARE[0] * n // SHARE[1])


class TokenOrder:
    """Rare tokens first: by the estimated count, then by the hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts

    def prefix(self, tokens: np.ndarray) -> tuple[np.ndarray, int, float]:
        """The prefix of a sorted set, how many of its tokens a partner must share (or as many as the partner asks, if less),
        and the share of the set's tokens that are frequent."""
        n = len(tokens)
        counts, share = np.ones(n, np.int64), 0.0
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = self.tokens[at] == tokens
            share = float(known.mean())
            if share:
                counts[known] = self.counts[at[known]]
                order = np.argsort(counts, kind="stable")
                tokens, counts = tokens[order], counts[order]
        base = n - least_overlap(n)
        cost = counts[: base + 1].mean()
        need = min(1 + sum(cost >= c for c in COSTS) + min(base // CHEAP, MOST_CHEAP), least_overlap(n))
        return tokens[: base + need], need, share


def profile(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: doc_id, class, n for each row; token, count for tokens that repeat in a block of a task."""
    names = ["doc_id", "class", "n", "token", "count"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=names)

        held: dict[int, np.ndarray] = {}
        size = 0
        for rows in batches:
            n, prints = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            for row, tokens in shingle_sets(rows["text"], WORDS):
                n[row], prints[row] = len(tokens), fingerprint(tokens)
                if len(tokens) and int(prints[row]) not in held:
                    held[int(prints[row])] = tokens
                    size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield block()
                    held, size = {}, 0
            none = pa.nulls(rows.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(prints), pa.array(n), none, none], names=names)
        if held:
            yield block()

    return map_arrow(id_and_text(docs), read, "doc_id long, class long, n long, token long, count long")


def token_order(profiled: DataFrame) -> TokenOrder:
    counted = profiled.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= LEAST_COUNT)
    sizes = sorted(((r["power"], r["n"]) for r in counted.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for power, n in sizes:  # a row for each power of two; whole powers are taken while they fit
        if (total := total + n) > FREQUENT:
            break
        least = power
    if least is None:
        return TokenOrder(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = counted.where(F.col("count") >= 1 << least).toArrow()
    tokens, counts = got["token"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(tokens)
    out = TokenOrder(tokens[order], counts[order].astype(np.int32))
    del got, tokens, counts, order
    give_back()
    return out


def prefixes(docs: DataFrame, order: TokenOrder) -> DataFrame:
    """token, class, meta (see ``_meta``)."""
    shared = docs.sparkSession.sparkContext.broadcast((order.tokens, order.counts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = TokenOrder(*shared.value), set()
        for rows in batches:
            parts, classes, metas = [], [], []
            for _, tokens in shingle_sets(rows["text"], WORDS):
                if not len(tokens):
                    continue
                name = int(fingerprint(tokens))
                if name in seen:
                    continue
                if len(seen) > 200_000:  # only spares work: the buckets drop repeated classes themselves
                    seen.clear()
                seen.add(name)
                part, need, share = order.prefix(tokens)
                parts.append(part)
                classes.append(np.full(len(part), name, np.int64))
                metas.append(_meta(len(tokens), np.arange(len(part)), share, need))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(metas))],
                    names=["token", "class", "meta"],
                )

    return map_arrow(id_and_text(docs).where("doc_id IS NOT NULL"), emit, "token long, class long, meta long")


def _meta(n: int, place: np.ndarray, share: float, need: int) -> np.ndarray:
    """One number of a row: size of the set, the token's place in its order, share of frequent tokens, matches asked for."""
    return (np.int64(n) << 35) | (place.astype(np.int64) << 11) | (int(share * 255) << 3) | need


def _central(meta: np.ndarray) -> np.ndarray:
    return (meta >> 3) & 255


def _may_link(a: np.ndarray, b: np.ndarray, before: np.ndarray | int) -> np.ndarray:
    """By the sizes of the sets, and by what can be shared from this token on if ``before`` tokens at most were shared earlier."""
    n, m = a >> 35, b >> 35
    left = np.minimum(n - ((a >> 11) & 0xFFFFFF), m - ((b >> 11) & 0xFFFFFF))
    return (SHARE[1] * np.minimum(n, m) >= SHARE[0] * np.maximum(n, m)) & ((SHARE[0] + SHARE[1]) * (left + before) >= SHARE[0] * (n + m))


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Arrays of whole buckets from rows that are sorted by their first column; a bucket may span batches."""
    held: list[list[np.ndarray]] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        now = [rows[c].to_numpy() for c in columns]
        if now[0][0] != now[0][-1] or (held and held[-1][0][-1] != now[0][0]):
            cut = int(np.searchsorted(now[0], now[0][-1])) if now[0][0] != now[0][-1] else 0
            yield [np.concatenate([*(h[k] for h in held), x[:cut]]) for k, x in enumerate(now)]
            held = [[x[cut:] for x in now]]
        else:
            held.append(now)
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(columns))]


_PAIR_NAMES = ["a", "b", "need", "meta", "token"]
_PAIR_SCHEMA = ", ".join(f"{n} long" for n in _PAIR_NAMES)


def _pairs(a, b, meta_a, meta_b, first: bool = False) -> pa.RecordBatch:
    """Pairs that may link; ``first``: by this as their first token in common, else as one of those they need."""
    ok = _may_link(meta_a, meta_b, 0 if first else np.minimum(meta_a & 7, meta_b & 7) - 1)
    a, b, need = a[ok], b[ok], np.minimum(meta_a & 7, meta_b & 7)[ok]
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([*map(pa.array, (np.minimum(a, b), np.maximum(a, b), need)), none, none], names=_PAIR_NAMES)


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of small buckets and stars of large ones (a, b, need); a large bucket's rows themselves (a, meta, token)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, name, meta in _buckets(batches, ["token", "class", "meta"]):
            if not len(token):
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (name[1:] != name[:-1])])
            token, name, meta = token[new], name[new], meta[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(start, len(token)))
            for n in range(2, SMALL + 1):
                some = start[size == n]
                if len(some):
                    i, j = np.triu_indices(n, 1)
                    x, y = (some[:, None] + i).reshape(-1), (some[:, None] + j).reshape(-1)
                    yield _pairs(name[x], name[y], meta[x], meta[y])
            large = np.repeat(size > SMALL, size)
            if large.any():
                at = np.flatnonzero(large)
                hub = np.concatenate([np.full(n, low + int(_central(meta[low : low + n]).argmax())) for low, n in zip(start[size > SMALL], size[size > SMALL], strict=True)])
                yield _pairs(name[hub[at != hub]], name[at[at != hub]], meta[hub[at != hub]], meta[at[at != hub]])
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(name[at]), none, none, pa.array(meta[at]), pa.array(token[at])], names=_PAIR_NAMES)

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "token").sortWithinPartitions("token", "class")
    return map_arrow(ordered, read, _PAIR_SCHEMA)


def cross_pairs(rows: DataFrame, star: bool) -> DataFrame:
    """Pairs across components of large buckets (token, class, meta, component), by the first token in common. ``star``:
    only with the most central class outside the component of the most central of all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, component, name, meta in _buckets(batches, ["token", "component", "class", "meta"]):
            if not len(token):
                continue
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            for low, high in zip(start, np.append(start[1:], len(token)), strict=True):
                whose, names, metas = component[low:high], name[low:high], meta[low:high]
                if star:
                    central = _central(metas)
                    others = whose != whose[central.argmax()]
                    outside = [int(np.where(others, central, -1).argmax())]
                else:  # of any pair across components, one lies outside the largest
                    value, number = np.unique(whose, return_counts=True)
                    outside = np.flatnonzero(whose != value[number.argmax()])
                left = np.ones(high - low, bool)
                for at in outside:
                    left[at] = star
                    k = np.flatnonzero(left & (whose != whose[at]))
                    yield _pairs(np.full(len(k), names[at]), names[k], np.full(len(k), metas[at]), metas[k], first=True)

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "token").sortWithinPartitions("token", "component", "class")
    return map_arrow(ordered, read, _PAIR_SCHEMA)


def counted(pairs: DataFrame) -> DataFrame:
    """Each pair once, with the number of tokens found in common and the matches it needs."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.max("need").alias("need"))


def needed_texts(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """class, text of the rows whose id may be one of ``keepers`` (id); none of the others is read again or shuffled. What
    passes wrongly, or twice, joins no pair or the same one again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = np.zeros(rows.num_rows, np.int64)
            for row, tokens in shingle_sets(rows["text"], WORDS):
                names[row] = fingerprint(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(names), rows["text"]], names=["class", "text"])

    known = id_and_text(docs).where("doc_id IS NOT NULL")
    return map_arrow(parted(known, "doc_id", keepers.toDF("doc_id"))[0], read, "class long, text string")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b of classes) whose whole texts link.

    The class of a pair that is in more of them is its hub. Each other side's text is fetched once for each pair and goes to
    its hub's, in chunks of CHUNK_LEAVES pairs that have the hub's text once each; so no text is repeated for every pair, and
    no hub's pairs meet in a task."""
    degree = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("a", "b").join(degree.toDF("a", "n_a"), "a").join(degree.toDF("b", "n_b"), "b")
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    chosen = sides.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.greatest("n_a", "n_b").alias("n"))
    placed = durable(chosen.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / CHUNK_LEAVES)).cast("int").alias("chunk")))
    wanted = placed.select("hub", "chunk", "leaf", F.col("leaf").alias("class")).unionAll(placed.select("hub", "chunk", F.lit(None).cast("long"), "hub").distinct())
    met = wanted.join(texts, "class").select("hub", "chunk", "leaf", "text")
    met = met.repartition(shuffle_partitions(pairs.sparkSession), "hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("leaf").asc_nulls_first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None  # the sets of the class that the following rows are compared with
        for rows in batches:
            out = []
            names, leaves = rows["hub"].to_numpy(), rows["leaf"].to_pylist()
            for row, tokens in shingle_sets(rows["text"], WORDS):
                if leaves[row] is None:
                    hub = tokens
                    continue
                both = len(np.intersect1d(hub, tokens, assume_unique=True))
                if SHARE[1] * both >= SHARE[0] * (len(hub) + len(tokens) - both):
                    out.append((min(int(names[row]), leaves[row]), max(int(names[row]), leaves[row])))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(met, read, "a long, b long").distinct()  # a class whose text came by several rows is compared as often


def linked_classes(docs: DataFrame, profiled: DataFrame) -> DataFrame:
    """class, component (the smallest doc_id that links reach) of the classes that share a bucket or a pair with another."""
    keeper = durable(profiled.where("token IS NULL AND doc_id IS NOT NULL AND n > 0").groupBy("class").agg(F.min("doc_id").alias("keeper")))
    found = durable(bucket_pairs(prefixes(docs, token_order(profiled))))
    large = found.where("token IS NOT NULL").select("token", F.col("a").alias("class"), "meta")
    # Pairs with too few matches stay only if both sides stand in large buckets, where they may have more.
    first, both = counted(found.where("token IS NULL")), large.select("class").distinct()
    weak = first.where("found < need").select("a", "b")
    for side in "ab":
        weak = weak.join(both.withColumnRenamed("class", side), side, "left_semi")
    first = durable(first.where("found >= need").select("a", "b", F.lit(True).alias("enough")).union(weak.select("a", "b", F.lit(False))))
    involved = first.select(F.col("a").alias("class")).union(first.select("b")).union(large.select("class")).distinct().join(keeper, "class")
    involved = durable(involved)

    def check(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(keeper, "class")
        return verified(pairs, durable(needed_texts(docs, durable(ends.select("keeper")))))

    tried, weak = first.where("enough").select("a", "b"), first.where("NOT enough").select("a", "b")
    links = durable(check(tried))

    def labels() -> DataFrame:
        reached = components(links.select("a", "b"))
        return durable(involved.join(reached.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("component")))

    label = labels()
    for star in (*[True] * STARS, False):
        placed = large.join(label, "class")
        mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token")
        rows = durable(placed.join(mixed, "token"))
        fresh = cross_pairs(rows, star).select("a", "b")
        if not star:
            across = weak
            for side in "ab":
                across = across.join(label.select(F.col("class").alias(side), F.col("component").alias(f"in_{side}")), side)
            fresh = fresh.union(across.where("in_a != in_b").select("a", "b"))
        fresh = durable(fresh.distinct().join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        tried = tried.union(fresh)
        links = durable(links.union(check(fresh)))
        label = labels()
        gc.collect()  # plans and broadcasts of this round: the JVM keeps what Python still names
    smallest = keeper.join(label, "class").groupBy("component").agg(F.min("keeper").alias("least"))
    return durable(label.join(smallest, "component").select("class", F.col("least").alias("component")))


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, class, n_shingles, component_id of each row."""
    profiled = durable(profile(docs))
    label = linked_classes(docs, profiled)
    keeper = profiled.where("token IS NULL AND doc_id IS NOT NULL AND n > 0").groupBy("class").agg(F.min("doc_id").alias("keeper"))
    whole = keeper.join(label, "class", "left").select("class", F.coalesce("component", "keeper").alias("component_id"))
    rows = profiled.where("token IS NULL").select("doc_id", "class", F.col("n").alias("n_shingles"))
    named = rows.where("doc_id IS NOT NULL AND n_shingles > 0").join(whole, "class").select("doc_id", "class", "n_shingles", "component_id")
    return named.unionAll(rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "class", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: one whose doc_id is the component's.

    What goes is told by id and set of shingles together, so a row with another text under the same id is judged by
    itself. Rows that link with nothing (without words, or with a null doc_id) stay. Only rows whose id loses a row are
    looked at again; the others aren't shuffled.
    """
    placed = _placed(docs).where("doc_id IS NOT NULL AND n_shingles > 0")
    told = durable(placed.groupBy("doc_id", "class").agg(F.first(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"))
    seen = docs.withColumn("__id", F.col("doc_id").cast("long"))
    maybe, others = parted(seen, "__id", told.select(F.col("doc_id").alias("__id")))
    at, schema = maybe.columns.index("text"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in maybe.schema) + ", __class long"

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = np.zeros(rows.num_rows, np.int64)
            for row, tokens in shingle_sets(rows.column(at).fill_null(""), WORDS):
                names[row] = fingerprint(tokens)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names)], names=[*rows.schema.names, "__class"])

    gone = told.where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("class").alias("__of"))
    named = map_arrow(maybe, name, schema)
    worded = one_of_each(named.where("__id IS NOT NULL AND __class != 0"), ["__id", "__class"])
    kept = worded.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__class") == F.col("__of")), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(named.where("__id IS NULL OR __class = 0").select(*columns)).unionAll(others.select(*columns))
