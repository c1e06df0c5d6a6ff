"""The multiset library against small hand-made sets."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodestrata.operators import zset as z
from lodestrata.operators.window import MovableWindow
from lodestrata.operators.zset import MULT, ZSet


@pytest.fixture(scope="module")
def left(spark):
    return ZSet.of(spark, [((1, "a"), 2), ((2, "b"), 1), ((3, "c"), 1)], "k long, v string")


@pytest.fixture(scope="module")
def right(spark):
    return ZSet.of(spark, [((1, "x"), 1), ((1, "y"), 3), ((4, "z"), 1)], "k long, w string")


def entries(zset):
    return sorted(((tuple(r)[:-1], r[MULT]) for r in zset.consolidate().df.collect()), key=str)


def test_inner_multiplies(left, right):
    assert entries(left.inner_join(right, "k")) == [((1, "a", "x"), 2), ((1, "a", "y"), 6)]


def test_outer_joins_keep_multiplicities(left, right):
    assert ((2, "b", None), 1) in entries(left.left_join(right, "k"))
    assert entries(left.right_join(right, "k"))[-1] == ((4, None, "z"), 1)
    assert len(entries(left.full_join(right, "k"))) == 5
    assert entries(left.join(right, "k", "anti")) == [((2, "b"), 1), ((3, "c"), 1)]


def test_anti_join_goes_by_net_mass(spark, left):
    gone = ZSet.of(spark, [((1, "x"), 1), ((1, "y"), -1), ((2, "q"), 1)], "k long, w string")
    assert entries(left.anti_join(gone, "k")) == [((1, "a"), 2), ((3, "c"), 1)]


def test_filter_by(left, right):
    assert entries(left.filter_by(right, "k")) == [((1, "a"), 8)]


def test_join_delta(spark, left, right):
    a = ZSet.of(spark, [((1, "a"), -2), ((4, "d"), 1)], "k long, v string")
    b = ZSet.of(spark, [((2, "n"), 1)], "k long, w string")
    whole = left.inner_join(right, "k").diff(left.concat(a).inner_join(right.concat(b), "k"))
    assert entries(ZSet.join_delta(left, a, right, b, "k")) == entries(whole)


def test_consolidate_negate_distinct_subtract(spark, left):
    assert entries(left.concat(left.negate())) == []
    assert entries(left.distinct()) == [((1, "a"), 1), ((2, "b"), 1), ((3, "c"), 1)]
    assert entries(left.subtract(ZSet.of(spark, [((1, "a"), 1), ((2, "b"), 5)], "k long, v string"))) == [((1, "a"), 1), ((3, "c"), 1)]
    assert left.size() == 4 and rows(left.rows()) == [(1, "a"), (1, "a"), (2, "b"), (3, "c")]


def test_json_round_trip(spark, left):
    texts = [r.value for r in left.to_json().collect()]
    assert '[{"k":1,"v":"a"},2]' in texts
    assert entries(ZSet.from_json(spark, texts, "k long, v string")) == entries(left)


def test_aggregates(spark):
    s = ZSet.of(spark, [((1, 0), 2), ((1, 5), 1), ((1, 7), 1), ((2, 9), 1), ((2, 9), -1), ((3, None), 1)], "k long, v long")
    got = s.group_by("k", total=z.total("v"), n=z.rows_count(), some=z.count("v"), mean=z.average("v"), lo=z.minimum("v"), hi=z.maximum("v"), mid=z.median("v"), top=z.mode("v"))
    assert [tuple(r)[:-1] for r in got.df.orderBy("k").collect()] == [(1, 12, 4, 3 + 1, 3.0, 0, 7, 2.5, 0), (3, None, 1, 0, None, None, None, None, None)]
    assert entries(s.count("k")) == [((1, 4), 1), ((3, 1), 1)]
    assert entries(s.filter("v > 0").min_by_key("k", "v")) == [((1, 5), 1)]
    assert entries(s.group_by("k", widest=z.custom(lambda m: F.max(F.col("v") * m)))) [0] == ((1, 7), 1)


def test_order(spark):
    s = ZSet.of(spark, [((k, v), 3) for k, v in [(1, "d"), (1, "b"), (2, "a"), (2, "c"), (2, "e")]], "k long, v string")
    assert rows(s.top_k("k", [F.asc("v")], limit=1, offset=1).df.drop(MULT)) == [(1, "d"), (2, "c")]
    assert rows(s.top_k("k", [F.desc("v")], limit=2, index="i").df.drop(MULT)) == [(1, "b", 1), (1, "d", 0), (2, "c", 1), (2, "e", 0)]
    assert [r.v for r in s.order_by([F.asc("v")], limit=2, offset=1).df.collect()] == ["b", "c"]
    placed = s.order_by_with_index([F.asc("v")], offset=1).df
    assert sorted((r["index"], r.v) for r in placed.collect()) == [(1, "b"), (2, "c"), (3, "d"), (4, "e")]
    texts = s.order_by_with_fractional_index([F.asc("v")]).df.orderBy("index").collect()
    assert [r.v for r in texts] == list("abcde")
    grouped = s.grouped_order_by_with_fractional_index("k", [F.asc("v")], limit=1).df
    assert {(r.k, r.v) for r in grouped.collect()} == {(1, "b"), (2, "a")}


def test_window_moves(spark):
    s = ZSet.of(spark, [((v,), 1) for v in range(6)], "v long")
    sizes = []
    window = MovableWindow(s, [], [F.asc("v")], limit=2, on_size=lambda size: sizes.append(size()))
    assert sizes == [6] and [r.v for r in window.rows().orderBy("index").collect()] == [0, 1]
    assert sorted((r.v, r[MULT]) for r in window.move(offset=1).df.collect()) == [(0, -1), (2, 1)]
    change = window.update(ZSet.of(spark, [((1,), -1)], "v long"))
    assert {(r.v, r[MULT]) for r in change.df.collect() if r.v in (1, 3)} == {(1, -1), (3, 1)}


def test_rows_and_taps(spark, left):
    seen, told = [], []
    out = left.pipe(lambda s: s.key_by(F.col("k") % 2), lambda s: s.rekey(F.col("k") + 1), lambda s: s.unkey()).tap(seen.append)
    assert out.columns == ["k", "v"] and len(seen) == 1
    left.debug("left", show=told.append)
    assert len(told) == 3 and told[0].startswith("left: [")
    called = []
    left.output(lambda row, n: called.append((row["k"], n)))
    assert sorted(called) == [(1, 2), (2, 1), (3, 1)]
    assert entries(left.map((F.col("k") * 10).alias("t"))) == [((10,), 2), ((20,), 1), ((30,), 1)]

    def shout(frames):
        for f in frames:
            yield f.assign(v=f.v.str.upper())

    assert entries(left.map_rows(shout, "k long, v string"))[0] == ((1, "A"), 2)
