"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf is a pre-token with its characters and tokens; inner nodes hold sums. An edit descends by the character sums to
the leaves that it touches, adds the boundary context (two leaves to the left, since a run of white space is split in two
pre-tokens at most by what follows it, and as many as a special token may reach back) and re-reads pre-tokens from there
until one ends where an old leaf ended behind the edit; from that point the old leaves hold. New pre-tokens take the old
leaves' places, and the sums above are updated; where there are more of them, the leaves are laid out anew, without
encoding any again.

``build_trees`` keeps the trees in a table, with the texts; ``edit_trees`` applies a batch of edits to it and gives the
table for the next. ``count_tokens`` does both in one pass for one edit of each document.

Defined results: null or empty text has 0 tokens; special tokens in a text are one token each, as the library has it; a
null doc_id stays null; repeated rows are counted each; edits of a document are applied in the order of their numbers, in
every row that has its id; edits beyond the text's end are cut to it; a negative position or count is an error; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, map_arrow
from .tokens import default_path

MEMO_PIECES = 400_000
SCHEMA = "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_reencoded_chars long"
#: A kept tree: its leaves' characters and tokens as little-endian unsigned 32-bit integers.
TREES = "doc_id long, text string, leaf_chars binary, leaf_tokens binary, n_tokens long, n_reencoded_chars long"


class PieceCounter:
    """Pre-tokens of a text, and their tokens, remembered."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library, self.memo = Tokenizer.from_file(path), {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: Characters before an edit that may belong to a special token which it completes.
        self.reach = max(map(len, special), default=1) - 1

    def ends(self, text: str, start: int = 0) -> Iterator[int]:
        """Ends of the pre-tokens from ``start`` on. Text is split at special tokens first, each of which is a pre-token."""
        marks = self.special.finditer(text, start) if self.special else iter(())
        while start < len(text):
            mark = next(marks, None)
            for found in self.pattern.finditer(text, start, mark.start() if mark else len(text)):
                yield found.end()
            if mark is None:
                return
            yield mark.end()
            start = mark.end()

    def split(self, text: str) -> list[str]:
        if not self.special or not self.special.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for end in self.ends(text):
            out.append(text[at:end])
            at = end
        return out

    def learn(self, pieces: set[str]) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo = {p: n for p in pieces if (n := self.memo.get(p)) is not None}
        new = [p for p in pieces if p not in self.memo]
        self.memo.update(zip(new, (len(e) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def counts(self, pieces: list[str]) -> list[int]:
        self.learn(set(pieces))
        return list(map(self.memo.__getitem__, pieces))


_made: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _made:
        _made[path] = PieceCounter(path)
    return _made[path]


class TokenTree:
    """Segment tree over a document's pre-tokens: node i has children 2i and 2i+1, leaves start at ``size``."""

    def __init__(self, text: str, chars, tokens):
        """``chars`` and ``tokens`` of each pre-token of the text."""
        self.text = text
        self._lay(np.asarray(chars, np.int64), np.asarray(tokens, np.int64))

    def _lay(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        n = len(chars)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n] = chars, tokens
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the pre-tokens, in order."""
        chars, tokens = self.chars[self.size :], self.tokens[self.size :]
        some = chars > 0
        return chars[some], tokens[some]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, or the last one, and the leaf's first character. Empty leaves hold none."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.chars[node])
            if place - before >= left and self.chars[node + 1]:
                before, node = before + left, node + 1
        return node - self.size, before

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        by = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def edit(self, place: int, delete: int, insert: str, known: PieceCounter) -> int:
        """Replaces ``delete`` characters at ``place``; returns the characters that were encoded again."""
        if place < 0 or delete < 0:
            raise ValueError("an edit's place and length can't be negative")
        place = min(place, len(self.text))
        delete = min(delete, len(self.text) - place)
        old_end, new_end = place + delete, place + len(insert)
        text = self.text[:place] + insert + self.text[old_end:]
        low, start = self.leaf_at(place)
        for back in range(len(self.text) + 1):
            if not start or (back >= 2 and start <= place - known.reach):
                break
            low, start = self.leaf_at(start - 1)
        pieces: list[str] = []
        high, high_end, at = low, start + int(self.chars[self.size + low]), start
        for end in known.ends(text, start):
            pieces.append(text[at:end])
            at = end
            if at < new_end:
                continue
            behind = at - new_end + old_end  # the same place in the old text
            while high_end < min(behind, len(self.text)):
                high, first = self.leaf_at(high_end)
                high_end = first + int(self.chars[self.size + high])
            if high_end == behind:
                break
        else:
            high = self.size - 1
        counts, places, lengths = known.counts(pieces), high - low + 1, list(map(len, pieces))
        if len(pieces) > places:
            (chars, tokens), (some,) = (self.chars[self.size :], self.tokens[self.size :]), np.nonzero(self.chars[self.size :])
            left, right = some[some < low], some[some > high]
            self._lay(np.concatenate([chars[left], lengths, chars[right]]), np.concatenate([tokens[left], counts, tokens[right]]))
        else:
            for k in range(places):
                self._put(low + k, lengths[k] if k < len(lengths) else 0, counts[k] if k < len(counts) else 0)
        self.text = text
        return at - start


def middle_edit(text: str) -> tuple[int, int, str]:
    """The edit that the query applies to every document: a correction in the middle of the text."""
    return len(text) // 2, min(12, len(text) // 4), "corrected, 2 words "


def _built(texts: list[str], known: PieceCounter) -> list[TokenTree]:
    split = [known.split(t) for t in texts]
    known.learn(set().union(*split))
    get = known.memo.__getitem__
    return [TokenTree(t, list(map(len, pieces)), list(map(get, pieces))) for t, pieces in zip(texts, split, strict=True)]


def count_tokens(docs: DataFrame, edit=middle_edit, tokenizer_path: str | None = None) -> DataFrame:
    """Counts of every document before and after ``edit(text) -> (place, delete, insert)``; None leaves it as it is."""
    path = tokenizer_path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for rows in batches:
            out = []
            for tree in _built(rows["text"].to_pylist(), known):
                before, pieces, change = tree.n_tokens, len(tree.leaves()[0]), edit(tree.text) if edit else None
                again = tree.edit(*change, known) if change else 0
                out.append((before, pieces, tree.n_tokens, again))
            yield pa.RecordBatch.from_arrays([rows["doc_id"], *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))] if out else [pa.array([], pa.int64())] * 5, names=[x.split()[0] for x in SCHEMA.split(", ")])
        known.memo.clear()

    return map_arrow(id_and_text(docs), count, SCHEMA)


def _kept(ids: pa.Array, trees: list[TokenTree], again: list[int]) -> pa.RecordBatch:
    leaves = [tree.leaves() for tree in trees]
    columns = [ids, pa.array([t.text for t in trees], pa.string()), *(pa.array([x[k].astype("<u4").tobytes() for x in leaves], pa.binary()) for k in (0, 1)), pa.array([t.n_tokens for t in trees], pa.int64()), pa.array(again, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in TREES.split(", ")])


def build_trees(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A row with its tree for each document: see TREES. Write it to keep it."""
    path = tokenizer_path or default_path()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for rows in batches:
            trees = _built(rows["text"].to_pylist(), known)
            yield _kept(rows["doc_id"], trees, [0] * len(trees))

    return map_arrow(id_and_text(docs), build, TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The trees after ``edits`` (doc_id, number, place, delete, insert), each document's in the order of their numbers. Only
    what edits touch is encoded again; n_reencoded_chars says how much of each document was."""
    path = tokenizer_path or default_path()
    by_doc = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("number", "place", "delete", "insert"))).alias("edits"))
    joined = trees.join(by_doc, F.col("doc_id") == F.col("of"), "left").drop("of")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for rows in batches:
            out, again = [], []
            for text, chars, tokens, changes in zip(*(rows[c].to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                tree = TokenTree(text, np.frombuffer(chars, "<u4"), np.frombuffer(tokens, "<u4"))
                again.append(sum(tree.edit(c["place"], c["delete"], c["insert"], known) for c in changes or []))
                out.append(tree)
            yield _kept(rows["doc_id"], out, again)

    return map_arrow(joined, apply, TREES)
