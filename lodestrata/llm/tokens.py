"""Public tokenizer files behind a bounded memo of words.

In the byte-level pre-tokenisation a space that stands between two characters that aren't white space
always begins a pre-token, and so does a line break there, so the words between them are encoded independently, and so
is a stop or comma behind a letter at a word's end. Most words of a corpus are repeated: the library encodes each new word
once, and a text's ids are the joined ids of its words, line breaks and marks. Words of letters alone are one pre-token each,
which go to the library's model by many. Texts with runs of white space go to the library whole.

A batch is cut, looked up and joined as whole arrays. A word of at most SHORT bytes is known by its bytes, its length and
whether a space precedes it, in 128 bits, so nothing is told by a hash alone: an open hash table finds them. Longer ones
stand in a dictionary.

The memo goes on from task to task of a Python worker, and holds MEMO_BYTES at most, about; then only the short words stay that
were met again after the batch which brought them, or none if those are too many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

#: Bytes of words, ids and the tables that hold them, about: a worker's memo stays below.
MEMO_BYTES = 56 << 20
#: What a remembered word takes: its key, ids and places in tables that may be doubled; a long one has two objects beside.
_WORD_BYTES, _LONG_BYTES = 60, 190
#: Bytes of a word that fit a key.
SHORT = 15
#: Words that are handed to the library together.
_PLAIN_WORDS, _OTHER_WORDS = 4_000, 2_000
_ODD_SPACE = re.compile(r"[ \n]\s")
#: What stands behind or before words as a pre-token of its own: their places in the memo.
_APART = "\n.,"
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: First bytes of all white space, and of some other characters.
_DOUBT = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: By the number of bytes that a key's halves hold of a word: the bits that are its own.
_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """The characters by which a byte-level vocabulary writes bytes, as a table for str.translate: printable Latin-1 stands
    for itself, the others follow 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(others)}}


def _joined(written: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of the texts, with some zeros behind; where each begins, and the end; and where spaces and line breaks stand."""
    begins = np.cumsum([0, *map(len, written)])
    raw = b"".join([*written, bytes(16)])
    data = np.frombuffer(raw, np.uint8)
    return raw, begins, np.flatnonzero((data == 32) | (data == 10))


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += keys[:, 1]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each first one on, as many as its length says, in a row."""
    at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return at


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and the rank of each key's own."""
    h = _hash(keys)
    order = np.argsort(h, kind="stable")
    if len(h) and ((h[order][1:] == h[order][:-1]) & (keys[order][1:] != keys[order][:-1]).any(1)).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # two keys of one hash
    by = keys[order]
    new = np.ones(len(by), bool)
    new[1:] = (by[1:, 0] != by[:-1, 0]) | (by[1:, 1] != by[:-1, 1])
    rank = np.empty(len(by), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


class WordTokenizer:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # it sees no word twice
        self.bare = Tokenizer(self.library.model)  # takes bytes as the vocabulary writes them, words between spaces
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.library.get_vocab_size()
        self.opens = np.zeros(size, bool)
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith(("Ġ", "Ċ"))
        self.letters = _byte_letters()
        self.apart = [self._whole(c) for c in _APART]
        self.forget()

    def forget(self) -> None:
        self.place: dict[tuple[bool, bytes], int] = {}  # of long words
        self.ids, self.first = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64)  # of the word at k from first[k] to first[k + 1]
        self.keys, self.slots = np.zeros((1 << 12, 2), np.uint64), np.full(1 << 13, -1, np.int32)
        self.again = np.zeros(1 << 12, bool)  # the words that were met again
        self.words = self.held = 0
        for ids in self.apart:
            self._remember(ids, np.array([len(ids)]))

    def shrink(self) -> None:
        """Forgets all words but the short ones that were met again."""
        stay = np.flatnonzero(self.again[: self.words])
        keys, (ids, lengths) = self.keys[stay], self._gather(stay)
        self.forget()
        if 2 * len(stay) * _WORD_BYTES <= MEMO_BYTES:
            self._add(keys, self._remember(ids, lengths))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _remember(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of new words with these ids."""
        n, low = self.words, self.first[self.words]
        more = n + len(lengths) + 1
        if more > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(more, len(self.first)), np.int64)])
        if low + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[low : low + len(ids)] = ids
        self.first[n + 1 : more] = low + np.cumsum(lengths)
        self.words = more - 1
        return np.arange(n, more - 1, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_hash(keys) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _enter(self, places: np.ndarray) -> None:
        """Puts words, none of which is there, into the hash table."""
        at, last = self._slot(self.keys[places]), len(self.slots) - 1
        while len(places):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            stay = np.flatnonzero(self.slots[at] != places)
            places, at = places[stay], at[stay] + 1 & last

    def _add(self, keys: np.ndarray, places: np.ndarray) -> None:
        if self.words > len(self.keys):
            more = max(self.words - len(self.keys), len(self.keys))
            self.keys = np.concatenate([self.keys, np.zeros((more, 2), np.uint64)])
            self.again = np.concatenate([self.again, np.zeros(more, bool)])
        self.keys[places] = keys
        self.held += len(places) * _WORD_BYTES
        if 2 * self.words > len(self.slots):
            old = self.slots[self.slots >= 0]
            self.slots = np.full(1 << (2 * self.words).bit_length(), -1, np.int32)
            self._enter(old)
        self._enter(places)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of words, less than 0 where there is none."""
        at, last = self._slot(keys), len(self.slots) - 1
        found = self.slots.take(at)
        open_ = np.arange(len(at))
        while True:
            place = found[open_]
            there, mine = self.keys.take(place, 0, mode="wrap"), keys if len(open_) == len(keys) else keys[open_]
            open_ = open_[(place >= 0) & ((there[:, 0] != mine[:, 0]) | (there[:, 1] != mine[:, 1]))]
            if not len(open_):
                return found
            at[open_] = at[open_] + 1 & last
            found[open_] = self.slots[at[open_]]

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of the words at these places, and the number of each word's."""
        first = self.first[which]
        lengths = self.first[which + 1] - first
        return self.ids[_spans(first, lengths)], lengths

    def _by_many(self, library, text: str, n: int, one) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the n words that are joined in ``text``, and their numbers: each begins by a token that opens a word. Else
        ``one(k)`` encodes each."""
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.opens[ids])
        if len(at) == n and at[0] == 0:
            return ids, np.diff(at, append=len(ids))
        each = [one(k) for k in range(n)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Places of distinct words that the memo doesn't have."""
        data, places = np.frombuffer(raw, np.uint8), np.empty(len(starts), np.int32)
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_LETTER[data], dtype=np.int32, out=sums[1:])
        plain = spaced & (sums[starts + lengths] - sums[starts] == lengths)
        some = np.flatnonzero(plain)
        for low in range(0, len(some), _PLAIN_WORDS):
            k = some[low : low + _PLAIN_WORDS]
            size = lengths[k] + 3
            text = data[np.maximum(_spans(starts[k] - 3, size), 0)]
            head = np.cumsum(size) - size
            for j, byte in enumerate(" Ġ".encode()):
                text[head + j] = byte
            ids, n = self._by_many(self.bare, text.tobytes().decode(), len(k), lambda j: self._whole(" " + raw[starts[k[j]] : starts[k[j]] + lengths[k[j]]].decode()))
            places[k] = self._remember(ids, n)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return places
        size = lengths[rest] + 1
        text = data[_spans(starts[rest], size)]
        text[np.cumsum(size) - 1] = ord(" ")
        kinds: tuple[list, list, list, list] = [], [], [], []  # spaced letters, other spaced ones, bare ones, those by themselves
        for pair in zip(rest.tolist(), text[:-1].tobytes().decode().split(" "), spaced[rest].tolist(), strict=True):
            word = pair[1]
            kinds[(0 if word.isalpha() else 1) if pair[2] else 2 if "!" <= word[0] <= "~" or word[0].isalpha() else 3].append(pair)
        for kind, pairs in enumerate(kinds):
            for low in range(0, len(pairs), _OTHER_WORDS):
                k, words, _ = zip(*pairs[low : low + _OTHER_WORDS], strict=True)
                if kind == 0:
                    written = (" " + " ".join(words)).encode().decode("latin-1").translate(self.letters).replace("Ġ", " Ġ")
                    ids, n = self._by_many(self.bare, written, len(k), lambda j: self._whole(" " + words[j]))
                elif kind == 1:
                    ids, n = self._by_many(self.library, " " + " ".join(words), len(k), lambda j: self._whole(" " + words[j]))
                elif kind == 2 and len(self.apart[0]) == 1:
                    line = self.apart[0]
                    ids, n = self._by_many(self.library, "\n" + "\n".join(words), len(k), lambda j: np.concatenate([line, self._whole(words[j])]))
                    ids, n = np.delete(ids, np.cumsum(n) - n), n - 1
                else:
                    each = [self._whole(w) for w in words]
                    ids, n = np.concatenate(each), np.array([len(x) for x in each])
                places[list(k)] = self._remember(ids, n)
        return places

    def _places(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        view = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
        keys = np.empty((len(starts), 2), np.uint64)
        keys[:, 0] = view[starts]
        keys[:, 0] &= _BITS[np.minimum(lengths, 8)]
        keys[:, 1] = view[np.minimum(starts + 8, len(view) - 1)]
        keys[:, 1] &= _BITS[np.clip(lengths - 8, 0, 7)]
        keys[:, 1] |= (np.minimum(lengths, SHORT + 1) | spaced.astype(np.int64) << 7).astype(np.uint64) << np.uint64(56)
        places = self._find(keys)
        self.again[places[places >= 0]] = True
        long = np.flatnonzero(lengths > SHORT)
        missing = np.flatnonzero((places < 0) & (lengths <= SHORT))
        if len(missing):
            one, rank = _distinct(keys[missing])
            one = missing[one]
            own = self._learn(raw, starts[one], lengths[one], spaced[one])
            self._add(keys[one], own)
            places[missing] = own[rank]
        if len(long):
            named = [(s, raw[a : a + n]) for s, a, n in zip(spaced[long].tolist(), starts[long].tolist(), lengths[long].tolist(), strict=True)]
            new = {name: k for name, k in zip(named, long.tolist(), strict=True) if name not in self.place}
            if new:
                k = np.array(list(new.values()))
                self.place.update(zip(new, self._learn(raw, starts[k], lengths[k], spaced[k]).tolist(), strict=True))
                self.held += sum(2 * len(word) + _LONG_BYTES for _, word in new)
            places[long] = [self.place[name] for name in named]
        return places

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > MEMO_BYTES:
            self.shrink()
        written = [t.encode() for t in texts]
        raw, begins, spaces = _joined(written)
        data = np.frombuffer(raw, np.uint8)
        doubt = np.searchsorted(begins, spaces[_DOUBT[data[spaces + 1]]], "right") - 1  # what may be white space follows
        known = [not w.endswith((b" ", b"\n")) for w in written]
        for k in np.unique(doubt).tolist():
            known[k] = known[k] and not _ODD_SPACE.search(texts[k])
        if not all(known):
            raw, begins, spaces = _joined([w for w, k in zip(written, known, strict=True) if k])
            data = np.frombuffer(raw, np.uint8)
        size = int(begins[-1])
        opens, cut = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        opens[begins] = True
        cut[spaces + 1] = True
        cut |= opens
        cuts = np.flatnonzero(cut)
        starts, ends = cuts[:-1], cuts[1:] - ~opens[cuts[1:]]
        some = np.flatnonzero(ends > starts)  # none before the space that a text begins with
        starts, ends = starts[some], ends[some]
        before, at_open = data[starts - 1], opens[starts]
        spaced, broken = ~at_open & (before == 32), ~at_open & (before == 10)
        last = data[ends - 1]
        marked = ((last == 46) | (last == 44)) & _LETTER[data[ends - 2]] & (ends - starts > 1)
        places = self._places(raw, starts, ends - starts - marked, spaced)
        n = 1 + broken + marked
        ahead = np.cumsum(n) - n
        which = np.zeros(int(n.sum()), np.int64)
        which[ahead + broken] = places
        which[(ahead + n - 1)[marked]] = np.where(last[marked] == 46, _APART.index("."), _APART.index(","))
        ids, lengths = self._gather(which)  # that of a line break is 0
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.append(ahead, len(which))[np.searchsorted(starts, begins)]] * 4
        joined, spans = ids.tobytes(), iter(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        out = []
        for text, k in zip(texts, known, strict=True):
            if k:
                low, high = next(spans)
                out.append(joined[low:high])
            else:
                out.append(self._whole(text).tobytes())
        return out


_made: dict[str, WordTokenizer] = {}


@contextmanager
def tokenizer(path: str) -> Iterator[WordTokenizer]:
    """One for each Python worker and path, with the memo of the tasks before."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    yield _made[path]
