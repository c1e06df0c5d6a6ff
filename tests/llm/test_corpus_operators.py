"""Joins over documents, classifiers and the pipeline: brute force, planted cases and held-out accuracy."""

import collections
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from lodestrata.llm import components, decontaminate, ngram_join, quality, sentence_spans, textkit, toxicity
from lodestrata.llm import rows as flagged
from lodestrata.llm.common import id_remainder

from .conftest import ODD, WORDS, prose
from .test_text_operators import UPPER, words_of


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(docs):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def edited(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.random()}"
    return " ".join(w)


def near_copies():
    """A large group whose copies link with the original but not with each other, chains, and bystanders."""
    base, line = prose(50, 150), prose(51, 12)
    docs = [(0, base)] + [(k, edited(base, k, 3)) for k in range(1, 60)] + [(100 + k, edited(base, k, 6)) for k in range(30)]
    docs += [(200 + k, line + " " + prose(300 + k, 40)) for k in range(40)] + [(300 + k, line) for k in range(5)]
    chain = prose(60, 120)
    for k in range(12):
        docs.append((400 + k, chain))
        chain = edited(chain, k, 2)
    return docs + [(500, None), (501, " "), (502, "one two"), (503, "One two")]


@pytest.mark.parametrize("small, frequent", [(8, 1 << 20), (2, 64), (2, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, frequent):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = near_copies()
    got = ngram_join.near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == linked(docs)


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    got = sorted((tuple(r) for r in ngram_join.near_duplicate_components(odd).collect()), key=str)
    want = linked(ODD)
    want = [(d, *want[d]) if d is not None else (None, len(shingles(t)), None) for d, t in ODD]
    assert got == sorted(want, key=str)
    assert ngram_join.near_duplicate_components(nothing).count() == 0
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 8").count() == 0
    assert ngram_join.keep_one_of_each(nothing).count() == 0


def test_near_copies_go_by_row(spark):
    """A row stays or goes by its own text, whatever else has its id; repeated rows of a text that stays are one."""
    a, b, c = prose(600, 80), prose(601, 80), prose(602, 80)
    docs = [(3, a), (5, edited(a, 1, 1)), (5, b), (5, b), (6, edited(b, 2, 1)), (6, c), (None, a), (None, a), (8, None), (8, None), (2, edited(c, 3, 1)), (9, "one two"), (9, "ONE two")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id int, text string, `class` int").repartition(3)
    kept = ngram_join.keep_one_of_each(frame)
    assert kept.schema == frame.schema
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == collections.Counter([(3, a), (5, b), (None, a), (None, a), (8, ""), (8, ""), (2, edited(c, 3, 1)), (9, "one two")])
    report = {(r.doc_id, r.component_id) for r in ngram_join.near_duplicate_components(frame).collect()}
    assert report == {(3, 3), (5, 3), (5, 5), (6, 5), (6, 2), (None, None), (8, 8), (2, 2), (9, 9)}


def test_flags_reach_the_driver_in_blocks(spark):
    docs = spark.range(-500, 30_000, 1, 3).selectExpr("id AS doc_id", "concat('t', id) AS text").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), 'none'"))
    gone = spark.range(0, 30_000, 3).selectExpr("id AS doc_id")
    flags = flagged.flag_count(10_000)
    table = flagged.flag_table(gone, "doc_id", flags).collect()
    assert len(table) <= flags // 4096  # a row for each word of 64 flags was about 9,500 of them
    assert 9_900 <= sum((w & (1 << 64) - 1).bit_count() for r in table for w in r[1]) <= 10_000
    maybe, others = flagged.parted(docs, "doc_id", gone)
    passed = {r["doc_id"] for r in maybe.collect()}
    assert set(range(0, 30_000, 3)) <= passed and len(passed) < 10_600
    assert collections.Counter(r["text"] for r in maybe.unionAll(others).collect()) == collections.Counter(r["text"] for r in docs.collect())


def test_prefix_and_fingerprint():
    order = ngram_join.TokenOrder(np.array([3, 9], np.uint64), np.array([50, 900], np.int32))
    prefix, need, share = order.prefix(np.arange(1, 11, dtype=np.uint64))
    assert prefix.tolist() == [1, 2, 4] and need == 1 and share == 0.2
    dense = ngram_join.TokenOrder(np.arange(1, 11, dtype=np.uint64), np.full(10, 300, np.int32))
    assert dense.prefix(np.arange(1, 11, dtype=np.uint64))[1] == 4
    a = np.array([1, 5, 7], np.uint64)
    assert ngram_join.fingerprint(a) != ngram_join.fingerprint(a[:2]) and ngram_join.fingerprint(a[:0]) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), *((k, k + 1) for k in range(20, 60))]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **dict.fromkeys(range(20, 61), 20)}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, odd, nothing):
    items = [(1, prose(70, 30)), (2, prose(71, 60)), (3, prose(72, 16)), (4, "too short"), (5, None), (None, prose(73, 30))]
    changed = items[1][1].split()
    for k in (7, 19, 33, 48):
        changed[k] = "other"
    docs = [
        (1, prose(80, 100) + " " + items[0][1].upper() + " " + prose(81, 50)),
        (2, prose(82, 30) + "\n" + " ".join(changed)),
        (3, items[2][1]),
        (4, prose(83, 400)),
        (5, prose(84, 20) + " " + " ".join(items[0][1].split()[:8]) + " " + prose(85, 20)),
        (6, prose(86, 20) + " " + " ".join(items[1][1].split()[20:40])),
        (7, " ".join(w for k, w in enumerate(items[1][1].split()) if k % 2) + " " + prose(87, 10)),
        (8, prose(73, 30)),
        (8, items[0][1] + " " + items[2][1]),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(decontaminate.contaminated(frame, bench(spark, items)).select("doc_id", "item_id", "n_matches"))
    assert got == [(1, 1, 30), (2, 2, 56), (3, 3, 16), (6, 2, 20), (8, 1, 30), (8, 3, 16)]
    kept = decontaminate.drop_contaminated(frame, bench(spark, items))
    assert rows(kept.select("doc_id")) == [(4,), (5,), (7,), (8,)]  # the row of 8 that holds nothing stays
    assert decontaminate.contaminated(odd, bench(spark, items)).count() == 0
    assert decontaminate.contaminated(nothing, bench(spark, items)).count() == 0
    assert decontaminate.contaminated(frame, bench(spark, [])).count() == 0
    assert decontaminate.drop_contaminated(odd, bench(spark, items)).count() == len(ODD)


def test_decontamination_of_short_items_with_substitutions(spark):
    for n, k in ((10, 2), (14, 2), (15, 3), (16, 3), (17, 3), (18, 3), (19, 3)):  # a seed hits wherever the substitutions stand
        reads = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
        for wrong in itertools.combinations(range(n), k):
            assert any(not any(a + i in wrong for i in m) for a in range(n - decontaminate.WINDOW + 1) for m in reads), (n, wrong)
    r = random.Random(3)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (1, 2, 4, 9, 10, 12, 15, 16, 18)]
    docs, want = [], []
    for n, text in items:
        least = n if n < 10 else -(-4 * n // 5)
        for wrong in [*range(n - least + 1), n - min(13, least) + 1]:
            for places in r.sample(list(itertools.combinations(range(n), wrong)), min(12, len(list(itertools.combinations(range(n), wrong))))):
                d = len(docs)
                docs.append((d, " ".join([prose(500 + d, r.randrange(30)), *(f"z{j}" if j in places else w for j, w in enumerate(text.split())), prose(900 + d, 9)])))
                if n - wrong >= least:
                    want.append((d, n))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items))
    assert rows(got.select("doc_id", "item_id")) == want


def split_sentences(text):
    out, now = [], []
    for line in text.split("\n"):
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            now.append(w.lower())
            if w[-1] in ".!?" or len(now) == sentence_spans.SENTENCE_WORDS:
                out.append(tuple(now))
                now = []
        if now:
            out.append(tuple(now))
            now = []
    return out


def removed(docs):
    """doc_id -> number of sentences covered by a repeated span that isn't its first occurrence."""
    found = collections.defaultdict(list)
    parts = {d: split_sentences(t) for d, t in docs}
    for d in sorted(parts):
        s = parts[d]
        for i in range(len(s)):
            j = i + sentence_spans.SPAN_SENTENCES
            while j <= len(s) and sum(map(len, s[i:j])) < sentence_spans.SPAN_WORDS:
                j += 1
            if j <= len(s):
                found[tuple(s[i:j])].append((d, i, j))
    gone = collections.defaultdict(set)
    for places in found.values():
        for d, i, j in sorted(places)[1:]:
            gone[d].update(range(i, j))
    return {d: len(g) for d, g in gone.items()}


def test_repeated_passages(spark, odd, nothing):
    passage, loose = prose(90, 55), " ".join(prose(91, 60).replace(".", "").split())
    docs = [(k, prose(100 + k, 60) + (".\n" if k % 2 else ". ") + passage + " " + prose(200 + k, 30)) for k in range(20)]
    docs += [(k, prose(300 + k, 40) + "\n" + loose) for k in range(30, 35)] + [(50, prose(400, 90)), (51, prose(401, 20) + "\n" + passage[:60]), (52, prose(402, 30) * 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    cut = {r.doc_id: r for r in sentence_spans.remove_repeats(frame).collect()}
    assert {d: r.n_removed for d, r in cut.items() if r.n_removed} == removed(docs)
    assert cut[0].text == docs[0][1] and passage[40:300] not in cut[7].text and cut[7].text.startswith(prose(107, 60))
    assert cut[50].text == docs[-3][1] and cut[51].n_removed is None
    out = sentence_spans.remove_repeats(odd)
    assert out.count() == len(ODD) and "hash" in out.columns and "__covered" not in out.columns
    assert sentence_spans.remove_repeats(nothing).count() == 0


def test_repeated_passages_inside_sentences(spark):
    r = random.Random(5)
    plain = lambda n: [r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    whole = plain(60)  # no stops at all
    some = plain(11) + ["x."] + plain(14) + ["y."] + plain(14) + ["z."] + plain(10)  # two whole sentences of 30 words
    docs = [(1, " ".join(plain(40) + whole + plain(40))), (2, " ".join(plain(40) + some + plain(40)))]
    docs += [(10 + k, " ".join(plain(21 + k) + ["inserted"] * (k % 2) + whole + plain(25))) for k in range(16)]
    docs += [(40 + k, " ".join([*plain(7 + k), "end."] * (k % 2) + plain(k) + some + plain(9 + k))) for k in range(16)]
    cut = {d.doc_id: d for d in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert cut[1].text == docs[0][1] and cut[2].text == docs[1][1]
    for d, text in docs[2:]:
        left, passage = cut[d].text.split(), set(whole if d < 40 else some)
        assert sum(w in passage for w in left) < len(passage) / 2 and cut[d].n_removed
        assert [w for w in left if w not in passage] == [w for w in text.split() if w not in passage]


def left_texts(docs):
    """doc_id -> what is left, from the units' bounds by plain tuples of words: every run from a unit on that is long enough,
    every run up to a unit that ends none of those, all but their first occurrences taken out."""
    parts, found = {}, collections.defaultdict(set)
    for d, text in docs:
        raw = text.encode()
        (w,) = textkit.words(pa.array([text]), len(raw) + 1)
        begin = sentence_spans.units(w)[0].tolist()
        said = [raw[a:b].decode().translate(UPPER) for a, b in zip(w.start, w.end)]
        n = len(begin) - 1
        long = lambda i, j: j - i >= sentence_spans.SPAN_SENTENCES and begin[j] - begin[i] >= sentence_spans.SPAN_WORDS
        runs = [(i, next((j for j in range(i + 1, n + 1) if long(i, j)), None)) for i in range(n)]
        runs = [r for r in runs if r[1] is not None]
        closed = {j for _, j in runs}
        runs += [(i, j) for j in range(1, n + 1) if j not in closed and (i := next((i for i in range(j - 1, -1, -1) if long(i, j)), None)) is not None]
        parts[d] = raw, w, begin, set()
        for i, j in runs:
            found[j - i, tuple(tuple(said[begin[k] : begin[k + 1]]) for k in range(i, j))].add((d, i, j))
    for places in found.values():
        for d, i, j in sorted(places)[1:]:
            parts[d][3].update(range(i, j))
    out = {}
    for d, (raw, w, begin, gone) in parts.items():
        cuts = [int(w.start[b]) for b in begin[:-1]] + [len(raw)]
        out[d] = (raw[: cuts[0]] + b"".join(raw[cuts[k] : cuts[k + 1]] for k in range(len(begin) - 1) if k not in gone)).decode() if len(begin) > 1 else raw.decode()
    return out


def test_left_texts_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    passages = [prose(700 + k, r.randrange(30, 90)) for k in range(4)]
    docs = []
    for d in range(60):
        text = prose(800 + d, r.randrange(5, 60))
        for _ in range(r.randrange(3)):
            one = r.choice(passages).split(" ")
            a, b = r.randrange(len(one) // 3), r.randrange(len(one) // 2, len(one))
            text += r.choice([" ", "\n", ". "]) + " ".join(one[a : b + 1]).upper() + " " + prose(900 + 7 * d, r.randrange(1, 30))
        docs.append((d, text))
    for least in (1000, 2):  # also with runs that are looked up by broadcast
        monkeypatch.setattr(sentence_spans, "HOT_LEAST", least)
        cut = {q.doc_id: q.text for q in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert cut == left_texts(docs)
    assert sum(cut[d] != t for d, t in docs) > 15


@pytest.mark.parametrize("least", [1000, 2])
def test_decontamination_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(decontaminate, "HOT_LEAST", least)
    r = random.Random(4)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(r.choice([3, 8, 10, 14, 25, 60])))) for k in range(25)]
    docs = []
    for d in range(120):
        words = prose(1200 + d, r.randrange(60)).split(" ")
        for _ in range(2):
            _, text = r.choice(items)
            part, rate = text.split(), r.choice([0, 0, 0.1, 0.2, 0.4])
            a = r.choice([0, 0, r.randrange(len(part))])
            words += [f"s{d}x{j}" if r.random() < rate else w for j, w in enumerate(part[a:])] + prose(1300 + d, 5).split(" ")
        docs.append((d, " ".join(words)))
    sure, may = set(), set()
    for d, text in docs:
        mine = text.split(" ")
        for k, item in items:
            theirs = item.split(" ")
            for shift in range(-len(theirs) + 1, len(mine)):
                same = [0 <= i + shift < len(mine) and mine[i + shift] == w for i, w in enumerate(theirs)]
                if sum(same) < min(3, len(theirs)):
                    continue
                n, share = len(theirs), -(-4 * len(theirs) // 5) if len(theirs) >= 10 else len(theirs)
                score, best = 0, 0
                held = []
                for x in same:  # the best stretch: a match counts one, a substitution takes two
                    held = held + [x] if score > 0 or x else []
                    score = max(0, score + (1 if x else -2))
                    held = held if score else []
                    if score > best:
                        best, most = score, sum(held)
                if sum(same) >= share or best and most >= min(13, share):
                    may.add((d, k))
                run = max((len(list(g)) for x, g in itertools.groupby(same) if x), default=0)
                if sum(same) >= share or run >= 13:
                    sure.add((d, k))
    got = set(rows(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench(spark, items)).select("doc_id", "item_id")))
    assert len(sure) > 60 and sure <= got <= may


def labelled(n):
    """Texts with insults or a made-up family of words in the toxic ones, and symbols in the poor ones."""
    docs, labels = [], []
    for k in range(n):
        r = random.Random(k)
        words, toxic, poor = prose(1000 + k, 60 + r.randrange(80)).split(), k % 6 == 0, k % 4 == 1
        if toxic:
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum", "loser"]) if k % 12 else "zorgw" + r.choice("abcdefg") + r.choice("xyz"))
        if poor:
            words = [w + "$#%" if r.random() < 0.7 else w for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if poor else 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = labelled(900)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None, None), (None, 1, 1), (5, 1, None)], LABELS), labels


def test_toxicity(spark, corpus, odd, nothing):
    docs, labels, truth = corpus
    model = toxicity.fit_toxicity(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(d, t) for d, _, t in truth if id_remainder(d, 5) == 0]
    assert np.mean([(score[d] >= 0.5) == t for d, t in held]) > 0.97
    lexicon = model.lexicon
    assert {("idiot", 0), ("zorgw", 5), ("zorg", 4)} <= set(zip(lexicon.written, lexicon.kinds.tolist(), strict=True))
    assert len(model.label_model.accuracies) > 24 and model.label_model.accuracies.shape[1:] == (2, 3)
    assert len(set(score.values())) > 0.95 * len(score)  # every text is read, also one that holds no term
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and 700 < clean.count() < 800
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.keep_clean(odd, model).schema == odd.schema
    assert toxicity.score_toxicity(nothing, model).count() == 0
    empty = toxicity.fit_toxicity(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {1 / (1 + np.exp(40.0))}


MARKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def naive_margin(text, model):
    """The classifier's margin from the written terms, a word at a time."""
    raw = [w.encode() for w in words_of(text)]
    cores = []
    for w in raw:
        for _ in range(4):
            w = w[:-1] if w and chr(w[-1]) in MARKS else w
            w = w[1:] if w and chr(w[0]) in MARKS else w
        cores.append(w)
    n, lexicon = max(1, len(raw)), model.lexicon
    terms = list(zip(lexicon.written, lexicon.kinds.tolist(), lexicon.dense.tolist(), strict=True))
    of = lambda term, kind: [i for i, c in enumerate(cores) if len(c) >= max(kind, 2) and (c[:kind] if kind else c) == term.encode()]
    plain = {(t, k): of(t, k) for t, k, dense in terms if not dense}
    dense = {(t, k): of(t, k) for t, k, dense in terms if dense}
    one, two = len({i for x in plain.values() for i in x}), len({i for x in dense.values() for i in x})
    most = max(map(len, dense.values()), default=0)
    often = sum(len(x) >= toxicity.DENSE_COUNT and len(x) >= toxicity.DENSE_RATE * n for x in dense.values())
    insults = sum(c.decode("utf-8", "replace") in toxicity.INSULTS for c in cores)
    log = np.log1p
    hits = [log(one), one >= 1, one >= 2, one >= 3, min(1, 20 * one / n), log(sum(map(bool, plain.values()))), log(two), log(most), min(1, 25 * most / n), log(often), often >= 1, log(insults)]
    as_written = re.findall(r"[^\x20\x09-\x0D]+", text)
    big = [sum("A" <= ch <= "Z" for ch in w) for w in as_written]
    size = [len(w.encode()) for w in as_written]
    total = max(1, sum(size))
    marks = lambda chars: sum(ch in chars for w in as_written for ch in w) / total
    seen = collections.Counter(words_of(text))
    address = sum(c.decode("utf-8", "replace") in toxicity.ADDRESS for c in cores)
    style = [sum(u >= 3 and 2 * u > k for u, k in zip(big, size, strict=True)) / n, sum(big) / total, *map(marks, ("!", "?", ".,;:-()'\"", "0123456789", "#$%&*@^~|<>=+_{}[]\\/"))]
    style += [total / n / 20, sum(k > 12 for k in size) / n, 1 - len(seen) / n, max(seen.values(), default=0) / n, address / n]
    x = np.concatenate([hits, np.clip((np.array(style) - model.centre) / model.scale, -4, 4)])
    z = model.intercept + float(x @ model.weights[: len(x)])
    begins = collections.Counter()
    for c in cores:
        if len(c) >= toxicity.HASHED_BYTES:
            _, key = toxicity._keys(np.frombuffer(c, np.uint8), np.array([0]), np.array([len(c)]), toxicity.HASHED_BYTES)
            begins[int(key[0]) % toxicity.HASHED] += 1
    return z + sum(model.weights[len(x) + b] * (k / n) ** 0.5 for b, k in begins.items())


def test_toxicity_scores_equal_plain_python(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.fit_toxicity(docs, labels)
    texts = [r.text for r in docs.limit(150).collect()] + ["", "   ", "!!! ???", "You IDIOT!!! you (moron), zorgwax zorgwbz. 12 a#b", "é" * 40 + " Ünüt '' -x- x", "zorgwax " * 400]
    got = model.score(pa.array(texts))
    want = [1 / (1 + np.exp(-np.clip(naive_margin(t, model), -40, 40))) for t in texts]
    assert np.abs(got - want).max() < 1e-9


def test_logistic_holds_its_sample_once():
    r = np.random.default_rng(6)
    x = r.random((4000, 1000), np.float32)
    target = (x[:, 0] > 0.5).astype(np.float64)
    tracemalloc.start()
    try:
        toxicity.logistic(x, target, np.full(1000, 1e-3), steps=3)
        assert tracemalloc.get_traced_memory()[1] < x.nbytes / 4
    finally:
        tracemalloc.stop()


def test_label_model_learns_accuracies_and_correlations():
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 3000)
    flip = lambda v, p: np.where(r.random(len(v)) < p, 1 - v, v)
    a = flip(y, 0.1)
    votes = np.stack([a, flip(a, 0.02), flip(y, 0.2), r.integers(0, 2, 3000)], 1) + 1
    model = toxicity.LabelModel()
    post = model.fit(votes, flip(y, 0.15))
    assert ((post > 0.5) == y).mean() > 0.9
    assert model.correlations[0, 1] > 5 * abs(model.correlations[0, 2])


def test_quality(spark, corpus, odd, nothing):
    docs, labels, truth = corpus
    model = quality.fit_quality(docs, labels)
    score = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [(d, q) for d, q, _ in truth if id_remainder(d, 3) == 1]
    assert np.mean([(score[d] >= 0.5) == q for d, q in held]) > 0.97
    again = quality.fit_quality(docs.repartition(7), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    got = quality.score_quality(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(nothing, model).count() == 0
    none = quality.fit_quality(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


def naive_features(text):
    """quality.FEATURES of a text, a word and a line at a time."""
    raw, ws = text.encode(), words_of(text)
    as_bytes = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    sets = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?", "bar": b"|", "sign": b"#$%&*@^~+=_<>{}[]\\/", "high": range(128, 256), "line": b"\n", "space": b" \t"}
    out = [np.log1p(len(raw)), np.log1p(len(ws)), np.mean([len(w) for w in as_bytes]) if ws else 0, np.log1p(max(map(len, as_bytes))) if ws else 0]
    out += [sum(b in chars for b in raw) / len(raw) if raw else 0 for chars in sets.values()]
    if not ws:
        return [*out, *[0] * 7]
    three = list(zip(ws, ws[1:], ws[2:]))
    lines = text.split("\n")
    out += [len(set(ws)) / len(ws), max(collections.Counter(ws).values()) / len(ws), np.mean([a == b for a, b in zip(ws, ws[1:])]) if len(ws) > 1 else 0]
    return [*out, len(set(three)) / len(three) if three else 1, len(set(lines)) / len(lines), np.log1p(len(ws) / len(lines)), np.mean([w[-1] in b".,;:!?" for w in as_bytes])]


def test_quality_scores_equal_plain_python(spark, corpus):
    docs, labels, _ = corpus
    model = quality.fit_quality(docs, labels)
    texts = [q.text for q in docs.limit(120).collect()] + ["", "  ", "a", "A!! b?\nA!! b?\n\n|x| 12,5 é", "w " * 500]
    got = quality.features(pa.array(texts))
    want = np.array([naive_features(t) for t in texts])
    assert np.abs(got - want).max() < 1e-9
    for x, score in zip(got, model.score(got), strict=True):
        z, at = model.intercept, []
        for f, value in enumerate(x):
            place = sum(value >= cut for cut in model.cuts[f])
            z += model.tables[f][place]
            at.append(model.coarse[f][place])
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[at[a], at[b]]
        assert abs(score - 1 / (1 + np.exp(-min(40, max(-40, z))))) < 1e-12


def test_pairs_find_what_mains_can_not():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit_additive(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_pipeline_equals_brute_force(spark, small):
    import corpus_pipeline as p
    from lodestrata.llm.packing import pack_documents

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = p.run(spark, small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = {r.doc_id for r in p.toxicity(spark, docs, small).collect()}
    keep = {}
    for d in sorted(clean):
        keep.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    kept = sorted(keep.values())
    kept = [d for d, (_, c) in linked([(d, texts[d]) for d in kept]).items() if d == c]
    items = [words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(d):
        w = words_of(texts[d])
        return any(sum(a == b for a, b in zip(w[i : i + len(item)], item)) >= 13 for item in items for i in range(max(1, len(w) - len(item) + 1)))

    kept = [d for d in kept if not leaks(d)]
    want = pack_documents(docs.where(docs.doc_id.isin(kept)))
    total = lambda df: sorted(((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect()))
    assert total(got) == total(want)
    assert got.agg({"length": "sum"}).first()[0] == sum(n for _, n in total(want))
    assert [name for name, _ in p.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "packing"]


def test_pipeline_of_odd_rows(spark, tmp_path, nothing):
    """Null and shared ids, repeated rows, null and empty texts, clashing columns; each stage against plain Python."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from lodestrata.llm.tokens import default_path

    docs, labels = labelled(240)
    passage = prose(2000, 40)
    docs += [(1000 + (d or 0) if d is not None else None, t) for d, t in ODD]
    docs += [(2000, "fine " + passage), (2000, prose(2001, 50)), (2001, prose(2001, 50) + " more"), (None, passage), (2002, "idiot moron scum loser idiot"), (2002, prose(2003, 30)), (2002, prose(2003, 30))]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, tier int, `class` string").repartition(4)
    folder = str(tmp_path / "tables")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    bench(spark, [(1, passage), (2, None)]).write.parquet(f"{folder}/benchmark.parquet")
    got = collections.Counter()
    for q in p.run(spark, folder).collect():
        got[q.doc_id, q.doc_tokens] += q.length
    model = toxicity.fit_toxicity(frame, spark.createDataFrame(labels, LABELS))
    rows_ = [(d, t or "") for d, t in docs if naive_margin(t or "", model) < 0]
    keep = {}
    for d, t in sorted(rows_, key=lambda x: (x[0] is None, x[0] or 0)):
        keep.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (d, t))
    named = {k: (d, t) for k, (d, t) in enumerate(sorted((x for x in keep.values() if x[0] is not None), key=lambda x: x[0]))}
    classes = linked([(k, t) for k, (_, t) in named.items()])
    least = collections.defaultdict(lambda: 1 << 62)
    for k, (_, c) in classes.items():
        least[c] = min(least[c], named[k][0])
    left = [(d, t) for k, (d, t) in named.items() if least[classes[k][1]] == d and " ".join(passage.split()[:13]) not in t]
    left += [x for x in keep.values() if x[0] is None]
    library = Tokenizer.from_file(default_path())
    want = collections.Counter()
    for d, t in left:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        want[d, n] += n
    assert got == want and (2002, 6) not in got and any(d == 2002 for d, _ in got) and sum(d == 2000 for d, _ in got) == 1
    empty = str(tmp_path / "empty")
    nothing.select("doc_id", "text").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{empty}/labels.parquet")
    bench(spark, []).write.parquet(f"{empty}/benchmark.parquet")
    assert p.run(spark, empty).count() == 0


def test_queries_run(spark, small):
    import __spark_entry__

    have = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in have} and "pipeline" in have
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    got = have["op2_ngram_join"](spark, small)
    assert got.count() == n and got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    got = have["op8_toxicity"](spark, small)
    assert got.count() == n and dict(got.dtypes)["held_out"] == "boolean" and dict(got.dtypes)["predicted"] == "int"
