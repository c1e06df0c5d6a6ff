"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting visits the features in turn and lets a shallow tree over the bins
(two cuts) add to that feature's lookup table. The strongest pairs, by what a tree over their coarse grid still gains,
are boosted the same way into two-dimensional tables. A text's score is the sum of its bins' entries, looked up for a
whole batch at once.

The fit uses a bounded sample of labelled rows (SAMPLE_ROWS) outside the held-out fold; scoring covers every row. Labels, lang, source
and doc_id are never inputs.

Defined results: a null text is empty and has features like any other; null labels are ignored, of repeated ones the
highest counts; without labels of both kinds every score is the share of label 1 (0.5 without any); rows with a null
doc_id are scored and not held out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, id_and_text, map_arrow
from .textkit import runs, words
from .toxicity import labelled_texts, sampled_labels

SAMPLE_ROWS = 20_000
BINS, GRID, PAIRS, ROUNDS, RATE = 48, 8, 8, 250, 0.08

_CLASSES = {
    "upper": [range(65, 91)],
    "lower": [range(97, 123)],
    "digit": [range(48, 58)],
    "stop": [b".,;:"],
    "bang": [b"!?"],
    "bar": [b"|"],
    "sign": [b"#$%&*@^~+=_<>{}[]\\/"],
    "high": [range(128, 256)],
    "line": [b"\n"],
    "space": [b" \t"],
}
_TABLE = np.zeros((256, len(_CLASSES)), bool)
for _k, (_sets,) in enumerate(_CLASSES.values()):
    _TABLE[list(_sets), _k] = True
FEATURES = ["log_bytes", "log_words", "word_length", "longest_word", *(f"share_{c}" for c in _CLASSES), "distinct_words", "commonest_word", "repeated_neighbours", "distinct_triples", "distinct_lines", "line_words", "words_with_stop"]


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text (no nulls)."""
    out = np.zeros((len(column), len(FEATURES)))
    base = 4 + len(_CLASSES)
    texts = column.to_pylist()
    for w in words(column):
        n_texts = len(w.first) - 1
        n_words = np.diff(w.first)
        triples, first3 = runs(w, 3)
        lengths = (w.end - w.start).astype(np.float64)
        sizes = np.array([len(t.encode()) for t in texts[w.rows]])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends_in_stop = np.isin(w.bytes[w.end - 1], np.frombuffer(b".,;:!?", np.uint8)) if len(w.end) else np.zeros(0, bool)
        shares = np.zeros((n_texts, len(_CLASSES)))
        for d in range(n_texts):
            row, a, b = out[w.rows.start + d], w.first[d], w.first[d + 1]
            size = sizes[d]
            row[0], row[1] = np.log1p(size), np.log1p(n_words[d])
            if size:
                shares[d] = np.bincount(w.bytes[bounds[d] : bounds[d + 1]], minlength=256) @ _TABLE / size
            if b > a:
                row[2], row[3] = lengths[a:b].mean(), np.log1p(lengths[a:b].max())
                hashed = np.sort(w.hash[a:b])
                changes = np.flatnonzero(hashed[1:] != hashed[:-1]) + 1
                spans = np.diff(np.concatenate([[0], changes, [b - a]]))
                row[base], row[base + 1] = len(spans) / (b - a), spans.max() / (b - a)
                row[base + 2] = (w.hash[a + 1 : b] == w.hash[a : b - 1]).mean() if b - a > 1 else 0
                three = triples[first3[d] : first3[d + 1]]
                row[base + 3] = len(np.unique(three)) / len(three) if len(three) else 1
                lines = texts[w.rows.start + d].split("\n")
                row[base + 4], row[base + 5] = len(set(lines)) / len(lines), np.log1p((b - a) / len(lines))
                row[base + 6] = ends_in_stop[a:b].mean()
        out[w.rows, 4:base] = shares
    return out


@dataclass
class AdditiveModel:
    """score = intercept + sum of tables[f][bin of f] + sum of pair tables[coarse bins]."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], 1)
        return fine, np.stack([self.coarse[f][fine[:, f]] for f in range(len(self.cuts))], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[fine[:, f]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[:, a], coarse[:, b]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _line_tree(g: np.ndarray, h: np.ndarray, cuts: int = 2) -> np.ndarray:
    """The step that a tree with up to ``cuts`` cuts over ordered bins gives each bin."""
    segments = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for low, high in segments:
            cg, ch = np.cumsum(g[low:high]), np.cumsum(h[low:high])
            if high - low < 2:
                continue
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], (low, high), low + k + 1)
        if best[1] is None:
            break
        segments.remove(best[1])
        segments += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for low, high in segments:
        step[low:high] = g[low:high].sum() / (h[low:high].sum() + 1.0)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best depth-2 tree over a grid: a cut of one axis, then one of the other in each half."""
    best, step = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            trial, total = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                pg, ph = gg[part].sum(0), hh[part].sum(0)
                cg, ch = np.cumsum(pg), np.cumsum(ph)
                gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
                k = int(gains.argmax())
                total += gains[k]
                trial[part, : k + 1] = cg[k] / (ch[k] + 1.0)
                trial[part, k + 1 :] = (cg[-1] - cg[k]) / (ch[-1] - ch[k] + 1.0)
            total -= _gain(g.sum(), h.sum())
            if total > best:
                best, step = total, trial.T if turned else trial
    return best, step


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> AdditiveModel:
    n_features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    coarse = [np.minimum(np.arange(len(c) + 1) * GRID // (len(c) + 1), GRID - 1) for c in cuts]
    model = AdditiveModel(cuts, coarse, [np.zeros(len(c) + 1) for c in cuts])
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model.intercept = float(np.log(mean / (1 - mean)))
    fine, rough = model.bins(x)
    check = np.arange(len(y)) % 7 == 0 if len(y) >= 700 else np.zeros(len(y), bool)
    train = ~check
    z = np.full(len(y), model.intercept)

    def loss() -> float:
        some = check if check.any() else train
        return float(np.logaddexp(0, np.where(y[some] == 1, -z[some], z[some])).mean())

    def boost(visit, state: list[np.ndarray], rounds: int) -> None:
        best, kept, since = loss(), [t.copy() for t in state], 0
        for _ in range(rounds):
            visit()
            now = loss()
            if now < best - 1e-5:
                best, kept, since = now, [t.copy() for t in state], 0
            elif (since := since + 1) >= 25:
                break
        for t, k in zip(state, kept, strict=True):
            t[:] = k

    def mains() -> None:
        for f in range(n_features):
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            at = fine[train, f]
            g = np.bincount(at, (y - p)[train], len(model.tables[f]))
            h = np.bincount(at, (p * (1 - p))[train], len(model.tables[f]))
            step = rate * np.clip(_line_tree(g, h), -4, 4)
            model.tables[f] += step
            z[:] += step[fine[:, f]]

    boost(mains, model.tables, rounds)
    z = model.margin(x)
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def grid(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (rough[:, a] * GRID + rough[:, b])[train]
        return tuple(np.bincount(at, v[train], GRID * GRID).reshape(GRID, GRID) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_grid_tree(*grid(a, b, p))[0], a, b) for a in range(n_features) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((GRID, GRID)) for _ in model.pairs]

    def interactions() -> None:
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            step = rate * np.clip(_grid_tree(*grid(a, b, p))[1], -4, 4)
            t += step
            z[:] += step[rough[:, a], rough[:, b]]

    boost(interactions, model.pair_tables, rounds // 3)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Learns only from labels whose crc32(doc_id) mod ``folds`` isn't ``held``."""
    chosen = sampled_labels(labels, "quality", fold(F.col("doc_id"), folds) != held, sample_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = features(rows["text"])
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["label"], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = map_arrow(labelled_texts(docs, chosen).select("doc_id", "label", "text"), read, "doc_id long, label int, x array<double>").toPandas()
    got = got.sort_values("doc_id")  # the fit doesn't depend on the order of partitions
    if got["label"].nunique() < 2:
        share = float(got["label"].mean()) if len(got) else 0.5
        cuts = [np.zeros(0)] * len(FEATURES)
        return AdditiveModel(cuts, [np.zeros(1, int)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), intercept=float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -40, 40)))
    return fit_additive(np.stack(got["x"]), got["label"].to_numpy())


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(model.score(features(rows["text"])), pa.float64())], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs), score, "doc_id long, score double")
