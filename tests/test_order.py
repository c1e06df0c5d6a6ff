"""Fractional indexes that stay, and windows over them."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.operators.fractional import FractionalOrder, between
from lodestrata.operators.window import MovableWindow
from lodestrata.operators.zset import ZSet


@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_between_keeps_order(sizes, seed):
    r, keys = random.Random(seed), []
    for n in sizes:
        at = r.randrange(len(keys) + 1)
        low, high = keys[at - 1] if at else None, keys[at] if at < len(keys) else None
        keys[at:at] = [between(low, high, k, n) for k in range(n)]
        assert keys == sorted(keys) and len(set(keys)) == len(keys) and all(keys)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_indexes_stay(spark, keys):
    r = random.Random(len(keys))
    now = {(x % 3, x * 10): 1 for x in range(60)}
    kept = FractionalOrder(ZSet(spark.createDataFrame(list(now), "g long, x long")), [F.desc("x")], keys)
    seen = {(q.g, q.x): q["index"] for q in kept.rows.collect()}
    for _ in range(3):
        change = {(x % 3, x): 1 for x in r.sample(range(-50, 700), 15)}
        change.update({row: -now[row] for row in r.sample(sorted(now), 6)})
        change[r.choice(sorted(now))] = 2  # one more of a row that is there
        out = {(q.g, q.x): q["__mult"] for q in kept.update(ZSet.of(spark, list(change.items()), "g long, x long")).df.collect()}
        before = set(now)
        for row, n in change.items():
            now[row] = now.get(row, 0) + n
        now = {row: n for row, n in now.items() if n > 0}
        assert out == {**{row: 1 for row in set(now) - before}, **{row: -1 for row in before - set(now)}}
        rows = {(q.g, q.x): (q["index"], q["__mult"]) for q in kept.rows.collect()}
        assert {row: n for row, (_, n) in rows.items()} == now
        assert all(rows[row][0] == index for row, index in seen.items() if row in rows)  # no row's index has moved
        seen = {row: index for row, (index, _) in rows.items()}
        for group in {g for g, _ in now} if keys else {None}:
            own = sorted((row for row in now if group is None or row[0] == group), key=lambda row: -row[1])
            assert [seen[row] for row in own] == sorted(seen[row] for row in own) and len({seen[row] for row in own}) == len(own)


def test_an_insert_changes_one_index(spark):
    window = MovableWindow(ZSet(spark.range(0, 1000, 2).toDF("x")), [], [F.asc("x")], limit=10, offset=100)
    before = {q.x: q["index"] for q in window.ordered.rows.collect()}
    change = window.update(ZSet.of(spark, [((201,), 1)], "x long"))
    after = {q.x: q["index"] for q in window.ordered.rows.collect()}
    assert {x for x in after if before.get(x) != after[x]} == {201}
    assert sorted((q.x, q["__mult"]) for q in change.df.collect()) == [(201, 1), (218, -1)]
    assert [q.x for q in window.rows().orderBy("index").collect()] == [200, 201, 202, 204, 206, 208, 210, 212, 214, 216]
