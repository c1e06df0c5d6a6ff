"""Exact dedup, packing, token files, token counts, backoff scores: whole results against plain Python versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import common, exact_dedup, lm_scores, packing, textkit, token_counts, token_files, tokens

from .conftest import ODD, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def expected_groups(pairs):
    groups = collections.defaultdict(list)
    for d, t in pairs:
        groups[SPACE.sub(" ", t or "")].append(d)
    out = []
    for norm, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def test_exact_groups(spark, odd, nothing):
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(odd).collect()), key=str)
    assert got == expected_groups(ODD)
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == one_of_each_text(ODD)
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def one_of_each_text(pairs):
    """(id, text) of the row that stays of each group, for sets of pairs in which equal rows are alike."""
    groups = collections.defaultdict(list)
    for d, t in pairs:
        groups[SPACE.sub(" ", t or "")].append((d is None, d or 0, t or ""))
    return sorted(min(g)[1:] for g in groups.values())


def test_exact_copies_go_by_row(spark):
    """Rows that share an id with a copy, null ids and repeated rows: one row of each text stays, whatever else has its id."""
    pairs = [(3, "A"), (5, "A"), (5, "B"), (None, "C"), (None, "C"), (7, "q"), (7, "q"), (7, "r"), (None, "A"), (None, "D"), (8, None), (9, ""), (9, "A")]
    frame = spark.createDataFrame([(d, t, "x") for d, t in pairs * 3], "doc_id int, text string, `a.b` string").repartition(4)
    kept = exact_dedup.drop_exact_copies(frame)
    assert kept.schema == frame.schema
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == one_of_each_text(pairs)


def test_exact_groups_of_many_copies(spark):
    pairs = [(d, "the same  text" if d % 3 else f"text {d}") for d in range(900)]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(pairs, "doc_id long, text string")).collect()), key=str)
    assert got == expected_groups(pairs)


def test_encoding_equals_the_library(library):
    texts = [t or "" for _, t in ODD] + ["", " ", "  a", "a  b", "a ", "a\n b", "a \nb", "a\n\nb", "\na\n", "x  y", "it's 's", "\t q", "a\t b", "1 2 3,4"]
    texts += ["".join(random.Random(s).choice("ab \n\t'.s1") for _ in range(40)) for s in range(300)]
    got = tokens.WordTokenizer(tokens.default_path()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_batch_looks_up_each_word_once(library, monkeypatch):
    class Counted(dict):
        looked = 0

        def get(self, *args):
            Counted.looked += 1
            return super().get(*args)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    words = ["don't", "naïve", "word.", "Ġx", "x,", "日本語。", "a.b", "\nline", "\x85", "&&&", "3,4", "plain", "plain."]
    texts = [" ".join(random.Random(s).choice(words) for _ in range(500)).replace(" \n", "\n") for s in range(40)]
    known = tokens.WordTokenizer(tokens.default_path())
    known.place = Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counted.looked < 100  # of 20,000 words
    monkeypatch.setattr(tokens, "MEMO_BYTES", 0)  # forgets between batches
    more = [f"{t} {' '.join(f'new{k} fresh{chr(97 + k % 26)}.' for k in range(9))}" for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(more)] == [library.encode(t, add_special_tokens=False).ids for t in more]
    assert known.encode([]) == [] and known.encode([""]) == [b""]


@pytest.mark.parametrize("one_hash", [False, True])
def test_words_are_told_apart_whole(library, monkeypatch, one_hash):
    """Short and long words, with and without a space before, zeros and marks at their ends, also if all hashes are equal."""
    if one_hash:
        monkeypatch.setattr(tokens, "_hash", lambda keys: np.zeros(len(keys), np.uint64))
    words = ["a", "a\0", "\0", "a.", "a,", ".", ",", "..", "a..", "b.a", "é.", "'s", "'s.", "x" * 15, "x" * 15 + ".", "x" * 16, "x" * 16 + "\0", "x" * 16 + ",", "é" * 8, "\t\tq", "q\t\t", "<|endoftext|>", "<|endoftext|>.", "\xa0w", "日本"]
    texts = ["".join(random.Random(s).choice(words) + random.Random(-s).choice(" \n") * (k < 8) for k in range(9)) for s in range(1, 30)]
    texts += [random.Random(s).choice(" \n").join(random.Random(s + k).choice(words) for k in range(60)) for s in range(200)] + ["", "\n", " a", "\na", *words]
    known = tokens.WordTokenizer(tokens.default_path())
    for low in range(0, len(texts), 40):
        some = texts[low : low + 40]
        assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_the_next_task_knows_the_words_of_the_last(monkeypatch):
    """And a word with a stop behind it is no new one."""
    path = tokens.default_path()
    with tokens.tokenizer(path) as known:
        first = known.encode(["An ordinary sentence stands\nhere, with extraordinarycompound words"])
    learned = []
    learn = tokens.WordTokenizer._learn
    monkeypatch.setattr(tokens.WordTokenizer, "_learn", lambda self, *args: learned.append(len(args[1])) or learn(self, *args))
    with tokens.tokenizer(path) as known:
        assert known.encode(["An ordinary sentence stands\nhere, with extraordinarycompound words"]) == first
        known.encode(["An ordinary, sentence. stands\nhere with, extraordinarycompound. words."])
    assert learned == []
    monkeypatch.setattr(tokens, "MEMO_BYTES", 0)
    with tokens.tokenizer(path) as known:
        assert known.encode(["An ordinary sentence"]) != first and sum(learned) == 3 and known.words == 3 + len(tokens._APART)


def test_a_full_memo_keeps_the_words_met_again(library, monkeypatch):
    known = tokens.WordTokenizer(tokens.default_path())
    common_words, rare = [f"common{k}" for k in range(50)], iter(range(10**6))
    texts = [[" ".join(["", *common_words, *(f"rare{next(rare)}" for _ in range(500)), "averyverylongword" + "x" * t])] for t in range(12)]
    monkeypatch.setattr(tokens, "MEMO_BYTES", 2000 * tokens._WORD_BYTES)
    held, learned, learn = [], [], known._learn
    monkeypatch.setattr(known, "_learn", lambda *args: learned.append(len(args[1])) or learn(*args))
    for some in texts:
        assert [np.frombuffer(x, "<u4").tolist() for x in known.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
        held.append(known.held)
    assert max(held) < 2600 * tokens._WORD_BYTES and any(b < a for a, b in zip(held, held[1:]))
    assert sum(learned) == 50 + 12 * 501  # the common ones once, although the memo was full in between


def check_packing(pieces, docs, library):
    want = sorted((str(d), tuple(library.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in docs)
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
        assert p.length > 0 and p.tier in packing.TIERS
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= own[0].tier
    short = [w for w in windows.values() if sum(p.length for p in w) != w[0].tier]
    by_doc = collections.Counter()
    for p in pieces:
        by_doc[str(p.doc_id), p.doc_tokens] += p.length
    assert sum(by_doc.values()) == sum(len(i) for _, i in want)
    ids = collections.defaultdict(list)
    for d, i in want:
        ids[d].append(np.array(i, "<u4"))
    for p in pieces:
        assert any(len(i) == p.doc_tokens and zlib.crc32(i[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for i in ids[str(p.doc_id)])
    groups = collections.defaultdict(list)
    for w in windows.values():
        groups[w[0].tier, w[0].step_group].append(w[0].tier)
    assert len({g for _, g in groups}) == len(groups)  # a group's windows are of one tier
    full = [sum(w) == packing.STEP_TOKENS for w in groups.values()]
    assert all(sum(w) <= packing.STEP_TOKENS for w in groups.values()) and full.count(False) <= len(packing.TIERS)
    return short


def test_packing(spark, odd, nothing, library):
    short = check_packing(packing.pack_documents(odd).collect(), ODD, library)
    assert len(short) <= odd.rdd.getNumPartitions()
    docs = [(k, prose(k, 20 + 37 * (k % 40))) for k in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    assert len(check_packing(packing.pack_documents(frame).collect(), docs, library)) <= 9
    assert packing.pack_documents(nothing).count() == 0


@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(500, 5000))
@settings(max_examples=40, deadline=None)
def test_packer_places_every_id_once(lengths, buffer):
    packer = packing.Packer(3, buffer_tokens=buffer)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype="<u4").tobytes())
    packer.pack(last=True)
    pieces = list(zip(*packer.out, strict=True))
    seen = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for doc, start, length, _, n, seq, offset, tier, _ in pieces:
        assert n == lengths[doc]
        seen[doc].append((start, length))
        windows[seq].append((offset, length, tier))
    assert {d: sorted(x) for d, x in seen.items()}.keys() == set(range(len(lengths)))
    for doc, spans in seen.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == lengths[doc]
    assert sum(sum(x[1] for x in w) != w[0][2] for w in windows.values()) <= 1


@given(st.integers(0, 5000), st.integers(1, 65536), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(n, kinds, seed):
    r = np.random.default_rng(seed)
    ids = (r.integers(0, kinds, n) * r.integers(0, 2, n)).astype(np.uint32)
    assert (token_files.decode_blocks(token_files.encode_blocks(ids), n) == ids).all()


def test_coder_works_on_whole_arrays_first():
    """Lanes that shift at a step, as long as they are many, aren't picked one by one; the few that shift again are."""
    r = np.random.default_rng(3)
    low, width = r.integers(0, 1 << 55, 4000), r.integers(1, 1 << 20, 4000) << r.integers(0, 36, 4000)
    got, sent, calls = (low.copy(), width.copy()), [[] for _ in low], []

    def shift(lanes, value):
        calls.append((len(lanes), value is got[0]))
        for k in lanes.tolist():
            sent[k].append(int(value[k]) >> 40)

    token_files._renormalise(*got, shift)
    assert all(whole for _, whole in calls) and [n for n, _ in calls] == sorted((n for n, _ in calls), reverse=True)
    for k, (a, w) in enumerate(zip(low.tolist(), width.tolist())):
        want = []
        while (settled := (a ^ (a + w)) < 1 << 40) or w < 1 << 37:
            w = w if settled else -a & ((1 << 37) - 1)
            want.append(a >> 40)
            a, w = (a << 16) & ((1 << 56) - 1), (w << 16) & ((1 << 56) - 1)
        assert (a, w, want) == (got[0][k], got[1][k], sent[k])


def test_blocks_are_independent_and_checked(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    ids = np.tile(np.arange(300, dtype=np.uint32), 40)
    blocks = token_files.encode_blocks(ids)
    assert len(blocks) == 12 and (token_files.decode_block(blocks[5], 1000) == ids[5000:6000]).all()
    raw = token_files.pack_frame([5, None], [100, len(ids) - 100], ids)
    docs, lengths, got = token_files.unpack_frame(raw)
    assert docs == [5, None] and lengths.tolist() == [100, len(ids) - 100] and (got == ids).all()
    for at in (30, len(raw) - 40, len(raw) // 2):
        with pytest.raises((ValueError, zlib.error)):
            token_files.unpack_frame(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
    with pytest.raises(ValueError, match="16 bits"):
        token_files.pack_frame([1], [1], np.array([1 << 16], np.uint32))


def test_coder_beats_deflate_on_text(library, small):
    """Texts as they are, not repeats made for the purpose: against deflate over all ids at once, without any reset."""
    texts = pq.read_table(f"{small}/../sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([np.array(e.ids + [0], np.uint32) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)])
    coded = sum(map(len, token_files.encode_blocks(ids)))
    assert coded < 0.85 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_token_files(spark, odd, nothing, library):
    path = common.shared_folder(spark, "tokens")
    token_files.write_tokens(odd, path, frame_ids=3000)
    got = token_files.read_tokens(spark, path).collect()
    want = sorted(((d is not None, d or 0, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in ODD), key=lambda x: (x[:2], len(x[2])))
    got = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(w[2]) for w in want)
    digests = token_files.read_tokens(spark, path, with_ids=False)
    assert sorted(map(tuple, digests.collect()), key=str) == sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str)
    token_files.write_tokens(nothing, path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_frames_hold_whole_blocks(spark):
    """A frame is closed before it has more ids than one block; only a document that is longer is a frame of more."""
    path, sizes = common.shared_folder(spark, "tokens"), [400, 500, 90, 20, 2500, 300, 999] * 12
    docs = spark.createDataFrame([(d, " ".join(["word"] * (n - 1))) for d, n in enumerate(sizes)], "doc_id long, text string")
    token_files.write_tokens(docs, path, frame_ids=1000)
    frames = spark.read.parquet(path).collect()
    assert sum(f.n_ids for f in frames) == sum(sizes) and any(f.n_docs > 1 for f in frames)
    assert all(f.n_ids <= 1000 or f.n_docs == 1 for f in frames)
    got = token_files.read_tokens(spark, path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == sizes and [r.start for r in got] == np.cumsum([0, *sizes[:-1]]).tolist()


def test_token_counts(spark, odd, nothing, library):
    plain = Tokenizer.from_file(tokens.default_path())
    got = sorted((tuple(r) for r in token_counts.count_tokens(odd).collect()), key=str)
    want = []
    for d, t in ODD:
        t = t or ""
        place, gone, new = token_counts.middle_edit(t)
        after = t[:place] + new + t[place + gone :]
        want.append((d, len(plain.encode(t).ids), len(plain.encode(after).ids)))
    assert [(d, n, m) for d, n, _, m, _ in got] == sorted(want, key=str)
    assert token_counts.count_tokens(nothing).count() == 0
    assert all(r[4] < 200 for r in got if r[0] == 9)


_PARTS = st.lists(st.sampled_from([*"ab '.\ns1é<|", "  ", "<|endoftext|>", "<|endof", "text|>", "|>"]), max_size=30).map("".join)


@given(_PARTS, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 14), _PARTS), max_size=6))
@settings(max_examples=300, deadline=None)
def test_edits_equal_counting_again(library, text, edits):
    known = token_counts.counter(tokens.default_path())
    pieces = known.split(text)
    tree = token_counts.TokenTree(text, list(map(len, pieces)), known.counts(pieces))
    for place, gone, new in edits:
        at = min(place, len(text))
        text = text[:at] + new + text[at + gone :]
        tree.edit(place, gone, new, known)
        assert tree.text == text and tree.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert tree.leaves()[0].tolist() == list(map(len, known.split(text)))  # no pre-tokens are lumped together


def test_trees_are_kept_between_batches_of_edits(spark, library, odd, nothing, tmp_path):
    texts = {d: t or "" for d, t in ODD if d not in (None, 8)}
    path, r = str(tmp_path / "trees0"), random.Random(2)
    token_counts.build_trees(odd).write.parquet(path)
    for batch in range(2):
        edits = [(d, k, r.randrange(len(texts[d]) + 3), r.randrange(9), prose(batch, 2) + " <|endoftext|>x") for k in range(3) for d in (1, 6, 9, 11)]
        for d, _, place, gone, new in sorted(edits, key=lambda e: e[1]):
            at = min(place, len(texts[d]))
            texts[d] = texts[d][:at] + new + texts[d][at + gone :]
        out = token_counts.edit_trees(spark.read.parquet(path), spark.createDataFrame(edits, "doc_id long, number int, place int, delete int, insert string"))
        path = str(tmp_path / f"trees{batch + 1}")
        out.write.parquet(path)
        got = {q.doc_id: q for q in spark.read.parquet(path).where("doc_id IS NOT NULL AND doc_id != 8").collect()}
        assert {d: (q.text, q.n_tokens) for d, q in got.items()} == {d: (t, len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts.items()}
        assert got[9].n_reencoded_chars < 600 and got[7].n_reencoded_chars == 0
    assert token_counts.build_trees(nothing).count() == 0


def backoff(docs):
    spread = {d: words_of(t) for d, t in docs}
    n_all = max(2, sum(map(len, spread.values())))
    cls = lambda w: int(next(textkit.words(pa.array([w]))).hash[0]) & (lm_scores.UNIGRAM_CLASSES - 1)
    seen = {w: cls(w) for ws in spread.values() for w in set(ws)}
    one = collections.Counter(seen[w] for ws in spread.values() for w in ws)
    two = collections.Counter(p for ws in spread.values() for p in zip(ws, ws[1:]))
    out = {}
    for d, ws in spread.items():
        own1, own2, total, hits = collections.Counter(seen[w] for w in ws), collections.Counter(zip(ws, ws[1:])), 0.0, 0
        for v, w in zip(ws, ws[1:]):
            others = two[v, w] - own2[v, w]
            if others:
                hits += 1
                total += math.log(others / max(1, one[seen[v]] - own1[seen[v]]))
            else:
                total += math.log(lm_scores.BACKOFF * max(1, one[seen[w]] - own1[seen[w]]) / max(1, n_all - len(ws)))
        n = max(0, len(ws) - 1)
        out[d] = (n, hits, total / n if n else None)
    return out


def test_backoff_scores(spark, nothing):
    docs = [(d, prose(d % 7, 30 + 11 * (d % 5))) for d in range(60)] + [(100, None), (101, "one"), (102, "Alpha  beta"), (103, "x" * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = backoff(docs)
    got = {r.doc_id: (r.n_bigrams, r.n_hits, r.score) for r in lm_scores.score_documents(frame).collect()}
    assert got.keys() == want.keys()
    for d, (n, hits, score) in want.items():
        assert got[d][:2] == (n, hits) and (score is None) == (got[d][2] is None)
        assert score is None or abs(got[d][2] - score) < 0.005
    assert lm_scores.score_documents(nothing).count() == 0


@pytest.mark.parametrize("in_table", [1, 300, 1 << 20])
def test_backoff_counts_are_of_single_words(spark, monkeypatch, in_table):
    """Exact scores by words themselves, not by hash classes, wherever the words are counted; all mixes of rare and frequent, also x x."""
    r = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    docs = [(d, " ".join(common[r.randrange(12)] if r.random() < 0.6 else f"w{r.randrange(3000)}" for _ in range(400))) for d in range(40)]
    docs += [(50, "w1 w1 w1 w2"), (51, "w1 w1 c1"), (52, "w7"), (53, "w1 w2 c1 w2"), (54, "lonely lonely lonely"), (55, "w7 c3")]
    docs += [(100 + k, " ".join(f"u{k}_{j}" for j in range(6000))) for k in range(10)]  # 60,000 more words
    docs += [(200 + k, " ".join(f"v{k}_{j}" for j in range(20000)) + " w1") for k in range(8)]
    spread = {d: words_of(t) for d, t in docs}
    n_all = sum(map(len, spread.values()))
    one = collections.Counter(w for ws in spread.values() for w in ws)
    two = collections.Counter(p for ws in spread.values() for p in zip(ws, ws[1:]))
    monkeypatch.setattr(lm_scores, "TABLE_WORDS", in_table, raising=False)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lm_scores.score_documents(frame).collect()}
    for d, ws in spread.items():
        own1, own2, total, hits = collections.Counter(ws), collections.Counter(zip(ws, ws[1:])), 0.0, 0
        for v, w in zip(ws, ws[1:]):
            n = two[v, w] - own2[v, w]
            hits += n > 0
            total += math.log(n / max(1, one[v] - own1[v])) if n else math.log(0.4 * max(1, one[w] - own1[w]) / (n_all - len(ws)))
        assert (got[d].n_bigrams, got[d].n_hits) == (len(ws) - 1, hits)
        assert got[d].score is None if len(ws) < 2 else abs(got[d].score - total / (len(ws) - 1)) < 0.002


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_of_any_order(spark, nothing, order):
    docs = [(d, prose(d % 7, 20 + 9 * (d % 5)) + " " + prose(40 + d % 3, 6 + d % 4)) for d in range(30)] + [(100, None), (101, "one"), (102, "Alpha  beta"), (103, "x x x x"), (104, prose(1, 25))]
    spread = {d: words_of(t) for d, t in docs}
    n_all = sum(map(len, spread.values()))
    grams = lambda ws, k: collections.Counter(zip(*(ws[j:] for j in range(k))))
    total = {k: sum((grams(ws, k) for ws in spread.values()), collections.Counter()) for k in range(1, order + 1)}
    got = {q.doc_id: q for q in lm_scores.score_orders(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), order).collect()}
    assert got.keys() == spread.keys()
    packed = {q.doc_id: q for q in lm_scores.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()} if order == 2 else {}  # says the same
    for d, ws in spread.items():
        own, out, hits = {k: grams(ws, k) for k in range(1, order + 1)}, 0.0, [0] * order
        count = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        for i in range(1, len(ws)):
            ln, k = 0.0, min(order, i + 1)
            while k > 1 and not count(tuple(ws[i - k + 1 : i + 1])):
                ln, k = ln + math.log(lm_scores.BACKOFF), k - 1
            hits[k - 1] += 1
            gram = tuple(ws[i - k + 1 : i + 1])
            out += ln + math.log(count(gram) / max(1, count(gram[:-1])) if k > 1 else max(1, count(gram)) / max(1, n_all - len(ws)))
        n = max(0, len(ws) - 1)
        assert (got[d].n_scored, got[d].hits) == (n, hits)
        assert got[d].score is None if not n else abs(got[d].score - out / n) < 1e-9
        if packed and n:
            assert abs(packed[d].score - got[d].score) < 0.002 and packed[d].n_hits == hits[1]
    assert lm_scores.score_orders(nothing, order).count() == 0


def test_backoff_scores_of_odd_rows(spark, odd):
    got = collections.Counter(r.doc_id for r in lm_scores.score_documents(odd).collect())
    assert got == collections.Counter({d for d, _ in ODD})
    assert rows(lm_scores.score_documents(odd).where("doc_id = 5").select("n_bigrams")) == [(2,)]
