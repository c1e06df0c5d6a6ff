"""Evaluation of programs: every construct of the language, and what each refused program is told."""

import itertools

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st

from lodestrata.errors import AnalysisError, FixpointError, ParseError
from lodestrata.plans.ast import program_to_dl
from lodestrata.plans.executor import Engine
from lodestrata.plans.inspect import inspect_json, inspect_text
from lodestrata.plans.parser import parse_program, parse_rule
from lodestrata.plans.fixpoint import fixpoint

REACH = """
.in
.decl Source(id: number)
.decl Arc(x: number, y: number)
.out
.decl Reach(id: number)
.rule
Reach(y) :- Source(y).
Reach(y) :- Reach(x), Arc(x, y).
"""


def run(spark, decls, rules, facts, level=None, **options):
    ins = "\n".join(f".decl {d}" for d in decls[0])
    outs = "\n".join(f".decl {d}" for d in decls[1])
    out = Engine(spark, level, **options).run(f".in\n{ins}\n.out\n{outs}\n.rule\n{rules}", facts)
    return {k: rows(v) for k, v in out.items()}


def test_reach(spark):
    out = Engine(spark).run(REACH, {"Source": [(1,)], "Arc": [(1, 2), (2, 3), (3, 4)]})
    assert rows(out["Reach"]) == [(1,), (2,), (3,), (4,)]
    assert out["Reach"].columns == ["id"]


@pytest.mark.parametrize(
    "rule, expected",
    [
        ("R(x) :- A(x, y), y > 1.", [(1,), (2,)]),
        ("R(x) :- A(x, 2).", [(1,), (2,)]),
        ("R(x) :- A(x, x).", [(1,), (2,)]),
        ("R(y) :- A(_, y), y * 2 + 1 > 4.", [(2,), (3,)]),
        ("R(x + y * 2) :- A(x, y).", [(4,), (6,), (8,), (10,)]),
        ("R(x - 5 / 2) :- A(x, _).", [(-2,), (-1,)]),
        ("R(x - 6 % 4) :- A(x, _).", [(-1,), (0,)]),
        ("R(x) :- A(x, _), True.", [(1,), (2,)]),
        ("R(x) :- A(x, _), False.", []),
        ("R(x) :- A(x, y), A(y, _).", [(1,), (2,)]),
        ("R(x) :- A(x, _), B(_, _).", [(1,), (2,)]),
        ("R(x) :- A(x, _), B(7, _).", []),
        ("R(x) :- A(x, _), !B(7, _).", [(1,), (2,)]),
        ("R(x) :- A(x, _), !B(_, _).", []),
        ("R(x) :- A(x, y), !B(y, x).", [(1,), (2,)]),
        ("R(x) :- A(x, y), !B(x, _).", [(2,)]),
        ("R(x) :- A(x, _), !A(_, x).", []),
        ("R(y) :- A(x, y), y = 3.", [(3,)]),
        ("R(a) :- A(a, b), A(c, d), a < c, b < d.", [(1,)]),
        ("R(1) :- B(_, _).", [(1,)]),
    ],
)
def test_rule(spark, rule, expected):
    out = run(spark, (["A(x: number, y: number)", "B(x: number, y: number)"], ["R(v: number)"]), rule, {"A": [(1, 1), (1, 2), (2, 2), (2, 3)], "B": [(1, 9)]})
    assert out["R"] == expected


def test_bags_inside_sets_outside(spark):
    decls = (["W(x: number, w: number)"], ["N(x: number, n: number)", "S(x: number, n: number)", "All(n: number)", "Set(x: number)"])
    out = run(spark, decls, "N(x, count(w)) :- W(x, w).\nS(x, sum(w)) :- W(x, w), W(x, _).\nAll(count(w)) :- W(_, w).\nSet(x) :- W(x, _).", {"W": [(1, 5), (1, 5), (2, 7)]})
    assert out == {"N": [(1, 2), (2, 1)], "S": [(1, 20), (2, 7)], "All": [(3,)], "Set": [(1,), (2,)]}


def test_aggregates(spark):
    decls = (["W(x: number, w: float)"], ["Lo(x: number, w: float)", "Hi(x: number, w: float)", "E(x: number, w: float)", "G(k: number, n: number)", "Two(x: number, n: number)", "None(n: number)"])
    rules = """Lo(x, min(w)) :- W(x, w). Hi(x, max(w)) :- W(x, w). E(x, sum(w * x)) :- W(x, w). G(x % 2, count(1)) :- W(x, w).
    Two(x, count(w)) :- W(x, w). Two(x, count(w)) :- W(x, w), w > 4.0. None(count(w)) :- W(_, w), w > 100.0."""
    out = run(spark, decls, rules, {"W": [(1, 5), (1, 10), (1, 1), (2, 7), (2, 3)]})
    assert out["Lo"] == [(1, 1.0), (2, 3.0)] and out["Hi"] == [(1, 10.0), (2, 7.0)]
    assert out["E"] == [(1, 16.0), (2, 20.0)] and out["G"] == [(0, 2), (1, 3)]
    assert out["Two"] == [(1, 5), (2, 3)] and out["None"] == []


def test_strings_floats_and_heads(spark):
    decls = (["P(id: number, n: string)", "Stock(s: string, p: float)", "Volume(s: string, n: number)"], ["Alice(id: number)", "Same(a: number, b: number)", "Kind(n: string, k: string)", "Cap(s: string, c: float)", "Half(s: string, h: float)", "X()"])
    rules = """Alice(id) :- P(id, "alice"). Same(a, b) :- P(a, n), P(b, n). Kind(n, "person") :- P(_, n). Cap(s, p * n) :- Stock(s, p), Volume(s, n).
    Half(s, p / 2) :- Stock(s, p). X(n, id) :- P(id, n)."""
    out = run(spark, decls, rules, {"P": [(1, "alice"), (2, "b,o\\b"), (3, "alice")], "Stock": [("A", 189.5), ("G", -7.5)], "Volume": [("A", 1000), ("G", 2)]})
    assert out["Alice"] == [(1,), (3,)] and out["Same"] == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]
    assert out["Kind"] == [("alice", "person"), ("b,o\\b", "person")] and out["Cap"] == [("A", 189500.0), ("G", -15.0)]
    assert out["Half"] == [("A", 94.0), ("G", -3.0)] and out["X"][0] == ("alice", 1)


def test_input_that_is_also_derived(spark):
    out = run(spark, (["File(p: string, m: number)", "Tag(p: string, t: string)"], ["Q(p: string, t: string)"]), 'Tag(p, "synthetic") :- File(p, m).\nQ(p, t) :- Tag(p, t).', {"File": [("a", 1)], "Tag": [("a", "literal")]})
    assert out["Q"] == [("a", "literal"), ("a", "synthetic")]


def test_case_sensitive_variables(spark):
    out = run(spark, (["A(x: number, y: number)"], ["R(x: number, y: number)"]), "R(X, x) :- A(x, X).", {"A": [(1, 2)]})
    assert out["R"] == [(2, 1)]


def test_recursion(spark):
    decls = (["E(x: number, y: number)"], ["T(x: number, y: number)", "N(x: number, y: number)", "Even(x: number)", "Odd(x: number)"])
    rules = """T(x, y) :- E(x, y). T(x, z) :- T(x, y), E(y, z). N(x, y) :- E(x, y). N(x, z) :- N(x, y), N(y, z).
    Even(1) :- E(1, _). Odd(y) :- Even(x), E(x, y). Even(y) :- Odd(x), E(x, y)."""
    out = run(spark, decls, rules, {"E": [(1, 2), (2, 3), (3, 4), (4, 2), (5, 6)]})
    reach = {(1, 2), (1, 3), (1, 4), (5, 6), *itertools.product((2, 3, 4), repeat=2)}
    assert set(out["T"]) == reach == set(out["N"])
    assert out["Even"] == [(1,), (2,), (3,), (4,)] and out["Odd"] == [(2,), (3,), (4,)]


def test_recursive_minimum_and_what_reads_it(spark):
    decls = (["E(x: number, y: number, w: number)"], ["D(x: number, d: number)", "L(n: number, c: number)", "Far(x: number)"])
    rules = """D(1, min(0)) :- E(1, _, _). D(y, min(d + w)) :- D(x, d), E(x, y, w). Far(x) :- D(x, d), d > 4.
    L(n, min(n)) :- E(n, _, _). L(y, min(c)) :- L(x, c), E(x, y, _)."""
    out = run(spark, decls, rules, {"E": [(1, 2, 10), (1, 3, 1), (3, 2, 2), (2, 4, 1), (4, 1, 1)]})
    assert out["D"] == [(1, 0), (2, 3), (3, 1), (4, 4)] and out["Far"] == []
    assert out["L"] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_set_head_in_a_component_with_a_minimum(spark):
    decls = (["E(x: number, y: number, w: number)"], ["D(x: number, d: number)", "Seen(x: number, d: number)"])
    rules = "D(1, min(0)) :- E(1, _, _). D(y, min(d + w)) :- Seen(x, d), E(x, y, w). Seen(x, d) :- D(x, d)."
    out = run(spark, decls, rules, {"E": [(1, 2, 10), (1, 3, 1), (3, 2, 2), (2, 4, 1)]})
    assert out["Seen"] == out["D"] == [(1, 0), (2, 3), (3, 1), (4, 4)]


def test_large_totals_are_kept_dealt(spark, monkeypatch):
    from lodestrata.plans import fixpoint as f

    monkeypatch.setattr(f, "KEEP_FROM", 2)
    monkeypatch.setattr(f, "MERGE_EVERY", 2)
    chain = [(k, k + 1) for k in range(9)]
    decls = (["E(x: number, y: number)"], ["T(x: number, y: number)", "D(x: number, d: number)"])
    out = run(spark, decls, "T(x, y) :- E(x, y). T(x, z) :- T(x, y), E(y, z). D(0, min(0)) :- E(0, _). D(y, min(d + 1)) :- D(x, d), E(x, y).", {"E": chain})
    assert out["T"] == [(a, b) for a in range(9) for b in range(a + 1, 10)] and out["D"] == [(k, k) for k in range(10)]


def test_recursive_maximum_and_rounds(spark):
    decls = (["E(x: number, y: number)"], ["Deep(x: number, d: number)"])
    rules = "Deep(x, max(0)) :- E(x, _). Deep(y, max(d + 1)) :- Deep(x, d), E(x, y)."
    assert run(spark, decls, rules, {"E": [(1, 2), (2, 3), (1, 3)]})["Deep"] == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(FixpointError, match="Deep"):
        run(spark, decls, rules, {"E": [(1, 2), (2, 1)]}, max_rounds=5)


def test_strata_with_negation(spark):
    decls = (["E(x: number, y: number)"], ["T(x: number, y: number)", "Not(x: number, y: number)"])
    out = run(spark, decls, "T(x, y) :- E(x, y). T(x, z) :- T(x, y), E(y, z). Not(x, y) :- E(x, _), E(_, y), !T(x, y).", {"E": [(1, 2), (2, 3)]})
    assert out["Not"] == [(2, 2)]


@pytest.mark.parametrize(
    "rule, message",
    [
        ("R(x) :- A(x).", "A has 2 columns, but an atom passes 1"),
        ("R(z) :- A(x, y).", "variable z"),
        ("R(x) :- A(x, y), !B(z, x).", "variable z"),
        ("R(x) :- A(x, y), q > 1.", "variable q"),
        ("R(x) :- Nowhere(x).", "Nowhere"),
        ("R(x) :- A(x, _), !R(x).", "not stratifiable"),
        ("R(n + 1) :- P(_, n).", "non-numeric"),
        ("R(min(n)) :- P(_, n).", "non-numeric"),
        ("R(x) :- P(x, n), n = 1.", "compared"),
        ("R(x) :- A(x, y), P(x, y).", "at once"),
        ('R(x) :- A(x, "s").', "string in a number"),
        ("R(count(x), y) :- A(x, y).", "last column"),
        ("R(count(x)) :- A(x, _). R(sum(x)) :- A(x, _).", "mixes"),
        ("R(x) :- A(x, _). R(x, y) :- A(x, y).", "columns"),
        ("R(sum(x)) :- A(x, _), R(x).", "can't be recursive"),
        ('R(x) :- A(x, _). R("s") :- A(_, _).', "at once"),
    ],
)
def test_refused(spark, rule, message):
    with pytest.raises(AnalysisError, match=message):
        run(spark, (["A(x: number, y: number)", "B(x: number, y: number)", "P(id: number, n: string)"], ["R(x: number)"]), rule, {})


def test_division_by_zero_is_an_error(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run(spark, (["A(x: number)"], ["R(x: number)"]), "R(x / 0) :- A(x).", {"A": [(1,)]})


@pytest.mark.parametrize("text", ["", ".in", ".in\n.decl A(x: number)\n.out\n.decl R(x: bool)", ".in\n.decl A()", ".out\n.decl R(x: number)\n.rule\nR(x) :- A(x)", ".out\n.decl R(x: number)\n.rule", ".in .decl A(x: number) .input a.exe"])
def test_parse_errors_say_where(text):
    with pytest.raises(ParseError, match="line "):
        parse_program(text)


def test_hints_comments_and_sections():
    assert (parse_rule("R(x) :- A(x). .plan").plan, parse_rule("R(x) :- A(x). .sip").sip) == (True, True)
    both = parse_rule('R(x, 1.5, "a b") :- A(x, -3, _), x == 4, !B(x), x - 1 > -2, True. .optimize')
    assert both.plan and both.sip and str(both) == 'R(x, 1.5, "a b") :- A(x, -3, _), x = 4, !B(x), x - 1 > -2, True.'
    program = parse_program("# c\n.in // d\n.decl A(x: number) .input a.facts\n.printsize\n.decl R(x: number)\nR(x) :- A(x). # end\n.in .decl B(s: string)\n.out .decl Q() .output q.csv\n.rule Q(s) :- B(s).")
    assert [d.name for d in program.edbs] == ["A", "B"] and program.idbs[1].path == "q.csv" and len(program.rules) == 2


_name = st.sampled_from(["x", "y", "z", "long_name", "_u"])
_const = st.one_of(st.integers(-99, 99), st.sampled_from([0.5, -2.25]), st.sampled_from(["s", "a b", ""]))


@st.composite
def _programs(draw):
    def factor():
        return draw(_name) if draw(st.booleans()) else (lambda v: f'"{v}"' if isinstance(v, str) else repr(v))(draw(_const))

    def arith():
        return " ".join([factor(), *(f"{draw(st.sampled_from('+-*/%'))} {factor()}" for _ in range(draw(st.integers(0, 2))))])

    def atom():
        return f"{draw(st.sampled_from(['A', 'B']))}({', '.join('_' if draw(st.integers(0, 4)) == 0 else factor() for _ in range(draw(st.integers(0, 3))))})"

    def predicate():
        return draw(st.sampled_from([atom, lambda: "!" + atom(), lambda: f"{arith()} {draw(st.sampled_from(['=', '!=', '<', '>=']))} {arith()}", lambda: "False"]))()

    rules = []
    for _ in range(draw(st.integers(1, 3))):
        last = f"{draw(st.sampled_from(['count', 'sum', 'min', 'max']))}({arith()})" if draw(st.booleans()) else arith()
        rules.append(f"R({', '.join([*(arith() for _ in range(draw(st.integers(0, 2)))), last])}) :- {', '.join(predicate() for _ in range(draw(st.integers(1, 3))))}.{draw(st.sampled_from(['', ' .plan', ' .sip', ' .optimize']))}")
    return ".in\n.decl A(x: number, y: string) .input A.csv\n.out\n.decl R(x: float)\n.rule\n" + "\n".join(rules)


@given(_programs())
@settings(max_examples=150, deadline=None)
def test_serialised_programs_parse_back(text):
    program = parse_program(text)
    assert parse_program(program_to_dl(program)) == program


def _closure(edges, sources):
    seen, todo = set(sources), list(sources)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return sorted((x,) for x in seen)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12), st.lists(st.integers(0, 5), max_size=4))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_reach_equals_search(spark, edges, sources):
    out = Engine(spark).run(REACH, {"Source": [(s,) for s in sources], "Arc": edges})
    assert rows(out["Reach"]) == _closure(edges, sources)


@pytest.mark.parametrize("level, sharing", [(0, True), (1, True), (2, False), (3, True)])
def test_optimiser_never_changes_results(spark, level, sharing):
    decls = (["A(x: number, y: number)", "B(x: number, y: number)", "C(x: number, y: number)"], ["R(x: number, n: number)", "Q(x: number, w: number)"])
    facts = {"A": [(1, 2), (1, 2), (2, 3)], "B": [(2, 5), (2, 6), (3, 5)], "C": [(5, 7), (6, 7), (5, 8)]}
    out = run(spark, decls, "R(x, count(w)) :- A(x, y), B(y, z), C(z, w).\nQ(x, w) :- C(z, w), A(x, y), B(y, z), w > 7.", facts, level, sharing=sharing)
    assert out == {"R": [(1, 6), (2, 2)], "Q": [(1, 8), (2, 8)]}


def test_generic_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    got = fixpoint(spark.createDataFrame([(1,)], "n long"), lambda new: new.join(edges, new.n == edges.a).select("b"))
    assert rows(got) == [(1,), (2,), (3,)]


def test_reports():
    text = inspect_text(REACH)
    for part in ("2 relations in, 1 out, 2 rules", "in   Arc(x: number, y: number)", "out  Reach(id: number)", "Reach(y) :- Source(y).", "step 0: Reach", "step 1: Reach (to a fixpoint)", "1. scan"):
        assert part in text
    import json

    report = json.loads(inspect_json(REACH.replace("Reach(y) :- Source(y).", "Reach(y) :- Source(y), Arc(y, _).")))
    assert [s["recursive"] for s in report["strata"]] == [False, True] and report["aggregations"] == []
    assert "CC by min(" in inspect_text(".in .decl Arc(x: number, y: number) .out .decl CC(n: number, c: number) CC(n, min(n)) :- Arc(n, _). CC(n, min(c)) :- Arc(o, n), CC(o, c).")


PAIRED = [
    ("R(a, b) :- A(a, k), B(b, k), a < b.", "R(a: number, b: number)"),
    ("R(a, b) :- A(a, k), B(b, k), C(k, 1), !N(a, b).", "R(a: number, b: number)"),
    ("R(b, a) :- A(a, k), B(b, k), A(a, 2), !N(_, b).", "R(b: number, a: number)"),
    ("R(x, y) :- A(x, p), A(y, p), x != y. R(x, y) :- A(x, p), R(p, q), A(y, q).", "R(x: number, y: number)"),
]


@pytest.mark.parametrize("rules, decl", PAIRED)
def test_pairs_neither_shuffled_nor_held(spark, monkeypatch, rules, decl):
    """Paired by chunks a head has the rows that the plain plan gives, also where both sides have several keys, and rows repeat."""
    from lodestrata.plans import pairs

    edges = lambda n, m, f: [(i % n, (i * i + f) % m) for i in range(40)] + [(n + 1, f), (n + 2, f)]
    facts = {"A": [*edges(9, 12, 1), (30, 3), (31, 4), (3, 30), (4, 31)], "B": edges(11, 12, 2), "C": [(k, k % 2) for k in range(12)], "N": [(a, b) for a in range(9) for b in range(11) if (a + b) % 3 == 0]}
    decls = "\n".join(f".decl {n}(a: number, b: number)" for n in facts)
    text = f".in\n{decls}\n.out\n.decl {decl}\n.rule\n{rules}"
    plain = rows(Engine(spark).run(text, facts)["R"])
    monkeypatch.setattr(pairs, "SMALL", 0)
    monkeypatch.setattr(pairs, "MANY", 0)
    monkeypatch.setattr(pairs, "CHUNK", 3)
    found = []
    keep = pairs._side
    monkeypatch.setattr(pairs, "_side", lambda *a: found.append(1) or keep(*a))
    got = Engine(spark).run(text, facts)["R"]
    assert rows(got) == plain and plain and found


def test_pairs_through_pairs_loop_over_inner_rows_alone(spark, monkeypatch):
    """The rounds hold rows that others are derived from, not the leaves' pairs."""
    from lodestrata.plans import executor, pairs

    up = [(100 + i, i % 4) for i in range(24)] + [(k, 50) for k in range(4)]
    text = ".in\n.decl Up(x: number, y: number)\n.out\n.decl R(x: number, y: number)\n.rule\nR(x, y) :- Up(x, p), Up(y, p), x != y. R(x, y) :- Up(x, p), R(p, q), Up(y, q)."
    monkeypatch.setattr(pairs, "SMALL", 0)
    monkeypatch.setattr(pairs, "MANY", 2)
    held, run = [], executor.semi_naive
    monkeypatch.setattr(executor, "semi_naive", lambda *a: held.append(run(*a)) or held[-1])
    got = rows(Engine(spark).run(text, {"Up": up})["R"])
    leaves = [(x, y) for x in range(100, 124) for y in range(100, 124) if x != y]
    inside = [(x, y) for x in range(4) for y in range(4) if x != y]
    assert got == sorted(leaves + inside)
    assert rows(held[0]["R"]) == inside
