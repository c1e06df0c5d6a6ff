"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Terms are mined from a bounded sample of labelled rows: whole words and word beginnings (of several lengths in
   bytes) that occur nearly only in toxic texts, or that are dense (DENSE_COUNT occurrences and DENSE_RATE of the words)
   nearly only there. Each kind of term, in GROUPS by hash, is a voter; a fixed list of insults is one; and each measure
   of style (shouting, exclamations, symbols, address, repetition, ...) is one, with thresholds from the sample. Each
   votes toxic, clean or abstains, whatever the others say.
2. The label model is a latent-class model whose votes may depend on one another: a tree of the strongest conditional
   correlations between voters is laid (Chow-Liu), and EM estimates each voter's accuracy given the class and its
   parent's vote. A given label is one more noisy voter, right LABEL_TRUST of the time at least.
3. A logistic regression is trained on the model's posterior labels. It reads measures of the lexicon's hits, the
   measures of style and hashed word beginnings of every text, and scores every whole text.

Only the sample (SAMPLE_ROWS labelled rows outside the held-out fold) goes to the fit; all else covers every row.
Texts are read with numpy, a batch at a time: words are told apart by 64-bit hashes of their bytes without the marks
around them, ASCII letters without case.

Defined results: a null or empty text is scored as one without words; null labels are ignored; of repeated labels the
highest counts; without labels of both kinds every score is the share of toxic labels (0 without any); rows with a
null doc_id are scored and not held out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, give_back, id_and_text, map_arrow
from .textkit import Words, byte_values, mix, position_powers, words

#: Labelled rows that the fit uses at most, about; the rest are left out by a hash of the id.
SAMPLE_ROWS = 20_000
#: Least log-likelihood ratio of a mined term: of a million terms that say nothing, about one gets so far by chance.
LEAST_EVIDENCE = 14.0
#: How many times rarer a term must be among clean texts, by its plain occurrence and where it is dense.
PLAIN_TIMES, DENSE_TIMES = 12, 3
DENSE_COUNT, DENSE_RATE = 2, 0.004
#: Bytes of word beginnings that are terms; 0 stands for whole words.
KINDS = (0, 4, 5, 6, 7, 8)
#: Voters of a kind.
GROUPS = 3
LABEL_TRUST = 0.75
#: Classes of hashed word beginnings that the linear classifier reads, and the bytes of those.
HASHED, HASHED_BYTES = 1024, 5
# Insults and forms of address.
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage clown clowns disgusting filth vermin imbecile cretin fool ugly hate kill".split()
ADDRESS = "you your yours tu te toi du dich dir sie vous votre usted".split()
STYLE = ("shouted words", "upper case", "exclamation marks", "question marks", "other marks", "digits", "symbols", "word length", "long words", "repeated words", "commonest word", "address")
HITS = 12
_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(c).isalnum() for c in range(128)]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in {"!": "!", "?": "?", ",": ".,;:-()'\"", "0": "0123456789", "#": "#$%&*@^~|<>=+_{}[]\\/"}.items()}


def _core(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word without the marks at its ends: at most four on either side."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end -= (end > start) & ~_LETTER[w.bytes[np.maximum(end - 1, 0)]]
        start += (start < end) & ~_LETTER[w.bytes[np.minimum(start, len(w.bytes) - 1)]]
    return start, end


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that have a term of the kind, and its 64-bit names."""
    size = end - start
    at = np.flatnonzero(size >= max(kind, 2))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    from_ = start[at]
    if kind:
        out = np.zeros(len(at), np.uint64)
        powers = position_powers(kind)
        for k in range(kind):
            out += byte_values()[data[from_ + k]] * powers[k]
    else:
        long = size[at]
        place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        values = byte_values()[data[np.repeat(from_, long) + place]] * position_powers(int(long.max()))[place]
        out = np.add.reduceat(values, np.cumsum(long) - long) + long.astype(np.uint64)
    return at, mix(out ^ np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _names(listed: list[str]) -> np.ndarray:
    """Whole-word names of some words, sorted."""
    (w,) = words(pa.array([" ".join(listed)]), 1 << 20)
    return np.sort(_keys(w.bytes, w.start, w.end, 0)[1])


def _inside(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Reading:
    """What is known of some texts: rows are texts."""

    hits: np.ndarray
    style: np.ndarray
    voted: np.ndarray
    hashed: tuple[np.ndarray, np.ndarray, np.ndarray]


class Lexicon:
    """Mined terms: names (sorted) with their kinds, whether they tell only where dense, and how they are written."""

    def __init__(self, names: np.ndarray, kinds: np.ndarray, dense: np.ndarray, written: list[str]):
        self.names, self.kinds, self.dense, self.written = names, kinds, dense, written
        self.insults, self.address = _names(INSULTS), _names(ADDRESS)

    def read(self, w: Words) -> Reading:
        n = len(w.first) - 1
        text = w.text_of_word()
        size = np.maximum(np.diff(w.first), 1).astype(np.float64)
        start, end = _core(w)
        of = lambda at: np.bincount(text[at], minlength=n)
        plain, dense = np.zeros(len(w.start), bool), np.zeros(len(w.start), bool)
        terms, most_count, most_rate, satisfied = (np.zeros(n) for _ in range(4))
        voted = np.zeros((n, len(KINDS) * 2 * GROUPS + 1), bool)
        rate = np.zeros((n, 2))
        hashed = None
        for k, kind in enumerate(KINDS):
            at, keys = _keys(w.bytes, start, end, kind)
            if kind == HASHED_BYTES:
                pair, count = np.unique(text[at] * HASHED + (keys % np.uint64(HASHED)).astype(np.int64), return_counts=True)
                hashed = pair // HASHED, pair % HASHED, count
            if kind == 0:
                for j, table in enumerate((self.insults, self.address)):
                    rate[:, j] = of(at[_inside(table, keys) >= 0])
            own = np.flatnonzero(self.kinds == kind)
            found = _inside(self.names[own], keys)
            at, found = at[found >= 0], own[found[found >= 0]]
            if not len(at):
                continue
            pair, count = np.unique(text[at] * len(self.names) + found, return_counts=True)
            whose, term = pair // len(self.names), pair % len(self.names)
            often = (count >= DENSE_COUNT) & (count >= DENSE_RATE * size[whose])
            tells = np.where(self.dense[term], often, True)
            group = (k * 2 + self.dense[term]) * GROUPS + (self.names[term] % np.uint64(GROUPS)).astype(np.int64)
            voted[whose[tells], group[tells]] = True
            terms += np.bincount(whose[~self.dense[term]], minlength=n)
            satisfied += np.bincount(whose[self.dense[term] & often], minlength=n)
            np.maximum.at(most_count, whose[self.dense[term]], count[self.dense[term]])
            np.maximum.at(most_rate, whose[self.dense[term]], (count / size[whose])[self.dense[term]])
            plain[at[~self.dense[found]]] = True
            dense[at[self.dense[found]]] = True
        voted[:, -1] = rate[:, 0] >= 2
        one, two = of(np.flatnonzero(plain)), of(np.flatnonzero(dense))
        hits = np.stack([np.log1p(one), one >= 1, one >= 2, one >= 3, np.minimum(1, 20 * one / size), np.log1p(terms), np.log1p(two), np.log1p(most_count), np.minimum(1, 25 * most_rate), np.log1p(satisfied), satisfied >= 1, np.log1p(rate[:, 0])], 1).astype(np.float64)
        return Reading(hits, self._style(w, text, size, rate[:, 1]), voted, hashed)

    def _style(self, w: Words, text: np.ndarray, size: np.ndarray, address: np.ndarray) -> np.ndarray:
        n = len(size)
        sums = lambda table: np.add.reduceat(table[w.bytes].astype(np.int64), w.start) if len(w.start) else np.zeros(0, np.int64)
        long = w.end - w.start
        total = np.maximum(np.bincount(text, long, n), 1)
        upper = sums(_UPPER)
        shouted = np.bincount(text[(upper >= 3) & (upper * 2 > long)], minlength=n)
        marks = [np.bincount(text, sums(_CLASS[c]), n) for c in "!?,0#"]
        pair, count = _repeats(text, w.hash)
        distinct, most = np.bincount(pair, minlength=n), np.zeros(n)
        np.maximum.at(most, pair, count)
        return np.stack([shouted / size, np.bincount(text, upper, n) / total, *(m / total for m in marks), total / size / 20, np.bincount(text[long > 12], minlength=n) / size, 1 - distinct / size, most / size, address / size], 1)


def _repeats(text: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and number of occurrences of each distinct word of a text."""
    order = np.lexsort((hashed, text))
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, h = text[order], hashed[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
    return t[first], np.diff(np.append(first, len(t)))


class LabelModel:
    """Latent class with tree-dependent ternary votes; accuracies and correlations are estimated by EM."""

    def fit(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 15) -> np.ndarray:
        """The posterior that each row is toxic."""
        n, voters = votes.shape
        given = np.maximum((votes > 0).sum(1), 1)
        said = np.where((votes > 0).any(1), (votes == 2).sum(1) / given, 0.5)
        post = np.clip((labels + said) / 2, 0.05, 0.95)  # labels and voters start with equal say
        one_hot = np.eye(3)[votes]  # rows, voters, votes
        for _ in range(rounds):
            weights = np.stack([1 - post, post])
            self.prior = (weights.sum(1) + 1) / (n + 2)
            pairs = np.stack([np.einsum("n,nia,njb->ijab", w, one_hot, one_hot, optimize=True) for w in weights])
            self.parents = self._tree(pairs, n)
            self.tables = []
            for j, parent in enumerate(self.parents):
                counts = pairs[:, j, j].diagonal(axis1=1, axis2=2)[:, None, :].repeat(3, 1) if parent is None else pairs[:, parent, j]
                marginal = pairs[:, j, j].diagonal(axis1=1, axis2=2) + 1
                counts = counts + marginal[:, None, :] / marginal.sum(-1)[:, None, None]
                self.tables.append(np.log(counts / counts.sum(-1, keepdims=True)))
            self.label = np.array([[(w * (labels == k)).sum() + 1 for k in (0, 1)] for w in weights])
            self.label /= self.label.sum(1, keepdims=True)
            right = np.maximum(self.label.diagonal(), LABEL_TRUST)  # the given labels say which class is which
            self.label = np.array([[right[0], 1 - right[0]], [1 - right[1], right[1]]])
            log = np.log(self.prior)[:, None] + np.log(self.label)[:, labels]
            for j, parent in enumerate(self.parents):
                log = log + self.tables[j][:, 0 if parent is None else votes[:, parent], votes[:, j]]
            log -= log.max(0)
            post = np.exp(log[1]) / np.exp(log).sum(0)
        self.accuracies = np.exp([t.mean(1) for t in self.tables])
        return post

    def _tree(self, pairs: np.ndarray, n: int) -> list[int | None]:
        """Each voter's parent in the maximum spanning tree of mutual information given the class."""
        p = (pairs + 0.1) / n
        own = p.diagonal(axis1=1, axis2=2)  # class, vote, vote, voter
        single = np.einsum("caav->cva", own)
        total = single.sum(-1, keepdims=True)
        ratio = p * total[:, :, None, :, None] / (single[:, :, None, :, None] * single[:, None, :, None, :])
        self.correlations = (p * np.log(np.maximum(ratio, 1e-12))).sum((0, 3, 4))
        parents: list[int | None] = [None] * p.shape[1]
        inside, outside = [0], set(range(1, p.shape[1]))
        while outside:
            a, b = max(((i, j) for i in inside for j in outside), key=lambda x: self.correlations[x])
            parents[b] = a if self.correlations[a, b] > 0.005 else None
            inside.append(b)
            outside.remove(b)
        return parents


def logistic(x: np.ndarray, target: np.ndarray, ridge: np.ndarray, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample; a ridge for each column. A matrix of float32 isn't copied."""
    x = x.astype(np.float32, copy=False)
    w, b, rate = np.zeros(x.shape[1], np.float32), 0.0, 0.1
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -40, 40))) - target).astype(np.float32)
        g = np.append(error @ x / len(x) + ridge * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * min(1.0, 4 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w.astype(np.float64), float(b)


@dataclass
class ToxicityModel:
    """Weights of the measures of hits, those of style (centred and scaled), and the hashed word beginnings."""

    lexicon: Lexicon
    weights: np.ndarray
    intercept: float
    centre: np.ndarray
    scale: np.ndarray
    label_model: LabelModel | None = None

    def columns(self, hits: np.ndarray, style: np.ndarray) -> np.ndarray:
        return np.concatenate([hits, np.clip((style - self.centre) / self.scale, -4, 4)], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of a string column without nulls."""
        out = np.full(len(column), self.intercept)
        plain = HITS + len(STYLE)
        for w in words(column):
            r = self.lexicon.read(w)
            z = self.intercept + self.columns(r.hits, r.style) @ self.weights[:plain]
            text, bucket, count = r.hashed
            rate = count / np.maximum(np.diff(w.first), 1)[text]
            out[w.rows] = z + np.bincount(text, self.weights[plain:][bucket] * _spread(rate), len(z))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _spread(rate: np.ndarray) -> np.ndarray:
    return np.sqrt(rate)


def sampled_labels(labels: DataFrame, name: str, usable: Column, rows: int) -> DataFrame:
    """About ``rows`` labelled ids at most, by a hash of the id: doc_id, label."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    one = one.where(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = one.count()
    return one if n <= rows else one.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label. The labels are a bounded sample, so they may be broadcast."""
    return id_and_text(docs).join(F.broadcast(labels), "doc_id")


def mine_terms(sample: DataFrame, n_clean: int, n_toxic: int) -> Lexicon:
    """Terms that say that a text is toxic, by occurring in it or by being dense there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            label = rows["label"].to_numpy()
            for w in words(rows["text"]):
                text, size = w.text_of_word(), np.diff(w.first)
                start, end = _core(w)
                for kind in KINDS:
                    at, keys = _keys(w.bytes, start, end, kind)
                    if not len(at):
                        continue
                    order = np.lexsort((text[at], keys))
                    at, keys, t = at[order], keys[order], text[at][order]
                    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (t[1:] != t[:-1])])
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(t)))
                    often = (n >= DENSE_COUNT) & (n >= DENSE_RATE * size[t[first]])
                    toxic = label[t[first] + w.rows.start] == 1
                    opens = np.flatnonzero(np.concatenate([[True], keys[first][1:] != keys[first][:-1]]))
                    sums = [np.add.reduceat(x.astype(np.int64), opens) for x in (~toxic, toxic, ~toxic & often, toxic & often)]
                    some = np.flatnonzero(sums[1])  # what occurs in clean texts alone here may in toxic ones elsewhere: it is sent without its letters
                    there = at[first[opens]]
                    written = np.full(len(opens), None, object)
                    for j in some:
                        a = start[there[j]]
                        written[j] = bytes(w.bytes[a : a + kind] if kind else w.bytes[a : end[there[j]]]).decode("utf-8", "replace").lower()
                    yield pa.RecordBatch.from_arrays([pa.array(keys[first[opens]].view(np.int64)), pa.array(np.full(len(opens), kind, np.int32)), *map(pa.array, sums), pa.array(written, pa.string())], names=["name", "kind", "clean", "toxic", "clean_dense", "toxic_dense", "written"])

    counted = map_arrow(sample.select("text", "label"), count, "name long, kind int, clean long, toxic long, clean_dense long, toxic_dense long, written string")
    summed = counted.groupBy("name", "kind").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "clean_dense", "toxic_dense")), F.min("written").alias("written"))
    share = n_toxic / (n_clean + n_toxic)

    def told(clean: Column, toxic: Column) -> Column:
        p = (toxic + 0.5) / (toxic + clean + 1)
        return toxic * F.log(p / share) + clean * F.log((1 - p) / (1 - share))

    plain = (F.col("clean") * PLAIN_TIMES <= F.col("toxic")) & (told(F.col("clean"), F.col("toxic")) >= LEAST_EVIDENCE)
    dense = (F.col("clean_dense") * DENSE_TIMES <= F.col("toxic_dense")) & (told(F.col("clean_dense"), F.col("toxic_dense")) >= LEAST_EVIDENCE)
    got = summed.where(plain | dense).select("name", "kind", (~plain).alias("dense"), "written").toArrow()
    names = got["name"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return Lexicon(names[order], got["kind"].to_numpy()[order], np.array(got["dense"].to_pylist(), bool)[order], [got["written"].to_pylist()[i] for i in order])


def style_votes(style: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """2 above the upper threshold, 1 below the lower one, 0 between."""
    return np.where(style > high, 2, np.where(style <= low, 1, 0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns only from labels whose crc32(doc_id) mod ``folds`` isn't ``held``."""
    chosen = sampled_labels(labels, "toxic", fold(F.col("doc_id"), folds) != held, sample_rows)
    sample = labelled_texts(docs, chosen)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        start = 40.0 if n_toxic else -40.0
        return ToxicityModel(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, bool), []), np.zeros(HITS + len(STYLE) + HASHED), start, np.zeros(len(STYLE)), np.ones(len(STYLE)))
    lexicon = mine_terms(sample, n_clean, n_toxic)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for w in words(rows["text"]):
                r = lexicon.read(w)
                text, bucket, count = r.hashed
                cuts = np.searchsorted(text, np.arange(len(r.hits) + 1))
                rate = (count / np.maximum(np.diff(w.first), 1)[text]).astype("<f4")
                raw = [np.ascontiguousarray(bucket[a:b].astype("<u2")).tobytes() + rate[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([rows["doc_id"][w.rows], rows["label"][w.rows], pa.array(list(r.hits), pa.list_(pa.float64())), pa.array(list(r.style), pa.list_(pa.float64())), pa.array(list(r.voted), pa.list_(pa.bool_())), pa.array(raw, pa.binary())], names=["doc_id", "label", "hits", "style", "voted", "hashed"])

    got = map_arrow(sample.select("doc_id", "label", "text"), read, "doc_id long, label int, hits array<double>, style array<double>, voted array<boolean>, hashed binary").toArrow().combine_chunks()
    order = np.lexsort((got["label"].to_numpy(), got["doc_id"].to_numpy()))  # the fit doesn't depend on the order of partitions
    gold, hashed = got["label"].to_numpy()[order], got["hashed"]
    hits, style, voted = (pc.list_flatten(got[c]).to_numpy().reshape(len(order), -1)[order] for c in ("hits", "style", "voted"))
    low, high = np.quantile(style, 0.5, axis=0), np.quantile(style, 0.95, axis=0)
    lexical = np.where(voted, 2, 1)
    used = np.append(lexical.max(0) > lexical.min(0), np.ones(len(STYLE), bool))  # a voter that always says the same says nothing
    votes = np.concatenate([lexical, style_votes(style, low, high)], 1)[:, used]
    model = LabelModel()
    post = model.fit(votes, gold)
    out = ToxicityModel(lexicon, np.zeros(0), 0.0, style.mean(0), np.maximum(style.std(0), 1e-6), model)
    del got, votes, lexical, voted
    give_back()  # before the one large array
    x = np.zeros((len(order), HITS + len(STYLE) + HASHED), np.float32)
    x[:, : HITS + len(STYLE)] = out.columns(hits, style)
    for i, at in enumerate(order.tolist()):
        raw = hashed[at].as_py()
        k = len(raw) // 6
        x[i, HITS + len(STYLE) + np.frombuffer(raw, "<u2", k).astype(np.int64)] = _spread(np.frombuffer(raw, "<f4", k, 2 * k).astype(np.float64))
    del hashed, hits, style
    ridge = np.concatenate([np.full(HITS, 1e-3), np.full(len(STYLE), 1e-2), np.full(HASHED, 3e-3)])
    out.weights, out.intercept = logistic(x, post, ridge)
    del x, gold
    give_back()  # the driver goes on to other stages
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    bare = ToxicityModel(model.lexicon, model.weights, model.intercept, model.centre, model.scale)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(bare.score(rows["text"]), pa.float64())], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs), score, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, all columns as they are; no shuffle."""
    bare, schema = ToxicityModel(model.lexicon, model.weights, model.intercept, model.centre, model.scale), docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(bare.score(rows.column(at).fill_null("")) < 0.5))

    return map_arrow(docs, keep, schema)
