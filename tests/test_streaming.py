"""Sessions, stores, the line protocol, links, files and the command line."""

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.cli import Args, main, parse_args, run_batch, run_inspect, run_streaming
from lodestrata.errors import DatalogError, SessionError
from lodestrata.operators.zset import MULT
from lodestrata.plans.ast import Attribute, RelDecl
from lodestrata.plans.executor import Engine
from lodestrata.sources import files
from lodestrata.streaming.protocol import run_stream, split_cells
from lodestrata.streaming.session import Session, attach
from lodestrata.streaming.store import Store
from lodestrata.streaming.sync import SyncLink

REACH = ".in\n.decl Source(id: number)\n.decl Arc(x: number, y: number)\n.out\n.decl Reach(id: number)\n.rule\nReach(y) :- Source(y).\nReach(y) :- Reach(x), Arc(x, y).\n"
MIXED = ".in\n.decl Arc(x: number, y: number)\n.out\n.decl Deg(x: number, n: number)\n.decl T(x: number, y: number)\n.decl Sink(y: number)\n.rule\nDeg(x, count(y)) :- Arc(x, y).\nT(x, y) :- Arc(x, y).\nT(x, z) :- T(x, y), T(y, z).\nSink(y) :- Arc(_, y), !Arc(y, _).\n"


def changes(got):
    return {n: sorted((tuple(r)[:-1], r[MULT]) for r in df.collect()) for n, df in got.items()}


def test_protocol(spark):
    out = []
    session = Session(spark, REACH, {"Source": [(1,)], "Arc": [(1, 2), (2, 3)]})
    run_stream(session, ["+ Arc 3,4", "", "# note", "- Arc 2,3", "", "nonsense", "+ Nowhere 1,2", "+ Arc 1", "+ Arc a,b", "+ Arc 9,9", "- Arc 9,9", "", ".quit", "+ Arc 4,5"], out.append)
    assert out[:6] == ["+1\tReach\t1", "+1\tReach\t2", "+1\tReach\t3", "+1\tReach\t4", "-1\tReach\t3", "-1\tReach\t4"]
    assert [x[:2] for x in out[6:]] == ["!\t"] * 4 and "unknown EDB" in out[7]


def test_end_of_input_is_an_advance(spark):
    out = []
    run_stream(Session(spark, REACH, {"Source": [(1,)], "Arc": [(1, 2)]}), ["+ Arc 2,3"], out.append)
    assert out[-1] == "+1\tReach\t3"


def test_facts_on_a_cycle_fall_with_their_support(spark):
    session = Session(spark, REACH, {"Source": [(1,)], "Arc": [(1, 2), (2, 3), (3, 2)]})
    session.advance()
    session.delete("Arc", 1, 2)
    assert changes(session.advance()) == {"Reach": [((2,), -1), ((3,), -1)]}
    assert rows(session.relation("Reach")) == [(1,)]


def test_groups_vanish_and_multiplicities_count(spark):
    session = Session(spark, MIXED)
    session.insert("Arc", 1, 2)
    session.insert("Arc", 1, 2)
    assert changes(session.advance())["Deg"] == [((1, 2), 1)]
    session.delete("Arc", 1, 2)
    assert changes(session.advance()) == {"Deg": [((1, 1), 1), ((1, 2), -1)]}
    session.delete("Arc", 1, 2)
    got = changes(session.advance())
    assert got["Deg"] == [((1, 1), -1)] and got["T"] == [((1, 2), -1)] and got["Sink"] == [((2,), -1)]


def test_session_refuses(spark):
    session = Session(spark, MIXED)
    for relation, row in (("Nope", (1,)), ("T", (1, 2)), ("Arc", (1,)), ("Arc", (1, "a")), ("Arc", (1, None))):
        with pytest.raises(SessionError):
            session.update(relation, row)
    session.close()
    assert session.close() == {}
    with pytest.raises(SessionError, match="closed"):
        session.insert("Arc", 1, 2)


def test_sink_and_frames(spark):
    got = []
    session = Session(spark, REACH, sink=lambda *x: got.append(x))
    session.update_df("Source", spark.createDataFrame([(7,)], "id int"))
    session.advance()
    assert got == [("Reach", (7,), 1)]


@given(st.lists(st.tuples(st.sampled_from([1, 1, -1]), st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=9), st.integers(2, 3))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_streaming_equals_batch(spark, ops, size):
    session, facts = Session(spark, MIXED), {}
    for low in range(0, len(ops), size):
        for sign, x, y in ops[low : low + size]:
            session.update("Arc", (x, y), sign)
            facts[x, y] = facts.get((x, y), 0) + sign
        session.advance()
    batch = Engine(spark).run(MIXED, {"Arc": [row for row, n in facts.items() for _ in range(n)]})
    for name, df in batch.items():
        assert rows(session.relation(name)) == rows(df)


GRAPH = """.in
.decl E(x: number, y: number)
.decl W(x: number, w: number)
.out
.decl T(x: number, y: number)
.decl N(x: number, n: number)
.decl S(x: number, w: number)
.decl P(x: number, y: number)
.decl L(x: number)
.rule
T(x, y) :- E(x, y). T(x, z) :- T(x, y), T(y, z).
N(x, count(y)) :- T(x, y), y != x.
S(x, sum(w)) :- E(x, y), W(y, w). S(x, sum(w + 1)) :- W(x, w).
P(x, y) :- T(x, y), T(y, x), W(x, _).
A(x) :- W(x, _). A(y) :- B(x), E(x, y). B(y) :- A(x), E(x, y).
L(x) :- A(x). L(x) :- B(x), !W(x, 1).
"""


def test_sessions_equal_batches_on_graphs_with_deletions(spark):
    r = random.Random(11)
    session, facts = Session(spark, GRAPH), {"E": {}, "W": {}}
    for epoch in range(6):
        for _ in range(12 if epoch < 2 else 4):
            name = r.choice(["E", "E", "W"])
            row = (r.randrange(9), r.randrange(9) if name == "E" else r.randrange(3))
            have = sorted(k for k, n in facts[name].items() if n > 0)
            sign = -1 if have and epoch and r.random() < 0.5 else 1
            row = r.choice(have) if sign < 0 else row
            session.update(name, row, sign)
            facts[name][row] = facts[name].get(row, 0) + sign
        was = {d.name: set(rows(session.relation(d.name))) for d in session.program.idbs} if epoch else {}
        got = changes(session.advance())
        batch = Engine(spark).run(GRAPH, {n: [row for row, k in have.items() for _ in range(k)] for n, have in facts.items()})
        for name, df in batch.items():
            now = rows(df)
            assert rows(session.relation(name)) == now, (epoch, name)
            assert got.get(name, []) == sorted([(row, 1) for row in set(now) - was.get(name, set())] + [(row, -1) for row in was.get(name, set()) - set(now)]), (epoch, name)


def test_epochs_write_only_what_changed(spark):
    session = Session(spark, REACH, {"Source": [(1,)], "Arc": [(k, k + 1) for k in range(1, 40)]})
    session.advance()
    base = session._state["Arc"].base, session._derived["Reach"].base
    session.delete("Arc", 30, 31)
    session.insert("Arc", 3, 500)
    assert {n: len(c) for n, c in changes(session.advance()).items()} == {"Reach": 11}
    assert session._state["Arc"].base is base[0] and session._derived["Reach"].base is base[1]
    assert [len(x.log) for x in (session._state["Arc"], session._derived["Reach"])] == [1, 1]


def test_structured_streaming(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("Source", "+", ["1"]), ("Arc", "+", ["1", "2"])], "rel string, op string, cols array<string>").coalesce(1).write.json(str(source))
    session, seen = Session(spark, REACH), []
    query = attach(session, spark.readStream.schema("rel string, op string, cols array<string>").json(str(source)), lambda c, n: seen.append(changes(c)), checkpointLocation=str(tmp_path / "ck"), trigger={"availableNow": True})
    query.awaitTermination(60)
    assert seen == [{"Reach": [((1,), 1), ((2,), 1)]}]
    assert session.apply_batch(spark.createDataFrame([], "rel string, op string, cols array<string>"), 0) == {}


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    path, columns = str(tmp_path / "state"), "rel string, op string, cols array<string>"
    session = Session(spark, MIXED, {"Arc": [(1, 2), (2, 3), (3, 1), (3, 1)]})
    with pytest.raises(SessionError):
        session.save(path)
    session.advance()
    for batch, rel in enumerate([("Arc", "+", ["3", "4"]), ("Arc", "-", ["1", "2"])]):
        session.apply_batch(spark.createDataFrame([rel], columns), batch)
        session.save(path)
    again = Session.load(spark, path)
    assert again.epoch == 3 and again.apply_batch(spark.createDataFrame([("Arc", "+", ["9", "9"])], columns), 1) == {}
    again.delete("Arc", 3, 1)
    again.insert("Arc", 4, 2)
    got = changes(again.advance())
    batch = Engine(spark).run(MIXED, {"Arc": [(2, 3), (3, 1), (3, 4), (4, 2)]})
    assert all(rows(again.relation(name)) == rows(df) for name, df in batch.items())
    assert got["Deg"] == [((3, 2), 1), ((3, 3), -1), ((4, 1), 1)]
    with pytest.raises(SessionError, match="no session"):
        Session.load(spark, str(tmp_path / "nowhere"))


def test_store(spark):
    store, calls = Store(spark, REACH), []
    stop = store.subscribe("Reach", lambda: calls.append("reach"))
    store.subscribe("Arc", lambda: calls.append("arc"))
    store.subscribe_program(lambda: calls.append("program"))
    arcs = store.collection("Arc")
    store.update("Source", (1,))
    arcs.insert(1, 2)
    assert store.snapshot("Reach") == [(1,), (2,)] and sorted(calls) == ["arc", "reach"]
    arcs.insert(1, 2)
    arcs.delete(1, 2)
    assert arcs.snapshot() == [(1, 2)]
    store.replace_program(".in .decl Arc(x: number, y: number) .out .decl Back(x: number, y: number) .rule Back(y, x) :- Arc(x, y).")
    assert store.snapshot("Back") == [(2, 1)] and "program" in calls
    store.replace_program(REACH)
    assert store.snapshot("Reach") == [(1,), (2,)]
    stop()
    with pytest.raises(SessionError):
        store.update("Reach", (1,))


def test_link(spark):
    a, b = Store(spark, REACH), Store(spark, REACH)
    link = SyncLink(a, b, ["Source", "Arc"], delay=1)
    a.update("Source", (1,))
    b.update("Arc", (1, 2))
    assert link.tick(1) == 2 and a.snapshot("Reach") == b.snapshot("Reach") == [(1,), (2,)]
    link.online = False
    a.update("Arc", (2, 3))
    assert link.tick(5) == 0
    link.online = True
    assert link.tick(1) == 1 and b.snapshot("Reach") == [(1,), (2,), (3,)]
    assert link.tick(5) == 0


def test_link_converges_on_equal_changes(spark):
    """The same row twice on one side and once taken back; both sides with the same row; offline changes on both."""
    a, b = Store(spark, REACH), Store(spark, REACH)
    link = SyncLink(a, b, ["Source", "Arc"])
    for diff in (1, 1, -1):
        a.update("Source", (1,), diff)
    b.update("Source", (1,))
    link.online = False
    a.update("Arc", (1, 2))
    b.update("Arc", (1, 2))
    b.update("Arc", (1, 2), -1)
    link.tick()
    link.online = True
    link.tick()
    link.send(0, 1, "Source", (7,), 1)  # sent again under an old number
    link.tick()
    for store in (a, b):
        assert {tuple(r)[:-1]: r[MULT] for r in store.session.facts("Source").collect()} == {(1,): 2}
        assert store.snapshot("Reach") == [(1,), (2,)]


DECL = RelDecl("A", (Attribute("n", "number"), Attribute("s", "string"), Attribute("w", "float")))


def parsed(spark, lines, delimiter=","):
    return rows(files.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), DECL, delimiter))


def test_lines(spark):
    got = parsed(spark, ['1,"hello, world",3.14', "", "2, plain ,-0.5\r", '3,"with ""quotes""",42', '4,"",1', "5,,2", "6,a\\b,3"])
    assert got == [(1, "hello, world", 3.14), (2, "plain", -0.5), (3, 'with "quotes"', 42.0), (4, "", 1.0), (5, "", 2.0), (6, "a\\b", 3.0)]
    assert parsed(spark, ["1|a,b|2"], "|") == [(1, "a,b", 2.0)] and parsed(spark, ["1\ta\t2"], "\t") == [(1, "a", 2.0)]


@pytest.mark.parametrize("line, message", [('1,"open,2', "quote"), ('1,"a"b,2', "quote"), ("1,a", "expected 3 values, got 2"), ("1,a,2,3", "got 4"), ("x,a,2", "number expected"), (",a,2", "number expected"), ("1,a,w", "float expected")])
def test_bad_lines(spark, line, message):
    with pytest.raises(Exception, match=message):
        parsed(spark, [line])


def test_cells():
    assert split_cells('a, "b ""c""", ,"d,e"') == ["a", 'b "c"', "", "d,e"]
    with pytest.raises(DatalogError):
        split_cells('"a')


def test_files(spark, tmp_path):
    decl = RelDecl("A", (Attribute("n", "number"), Attribute("s", "string")))
    assert files.default_path(decl) == "A.facts" and rows(files.read_relation(spark, decl, str(tmp_path))) == []
    (tmp_path / "A.facts").write_text("1,a\n2,b\n4,c\n")
    both = [rows(files.read_relation(spark, decl, str(tmp_path), worker=w, workers=2)) for w in (0, 1)]
    assert both == [[(2, "b"), (4, "c")], [(1, "a")]]
    (tmp_path / "n.txt").write_text("1, 2,\n3,4\n")
    assert rows(files.read_numbers(spark, str(tmp_path / "n.txt"), 2)) == [(1, 2), (3, 4)]
    files.write_csv_folder(files.read_relation(spark, decl, str(tmp_path)).coalesce(1), str(tmp_path / "parts"))
    files.merge_partitions(str(tmp_path / "parts"), str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_text() == "1,a\n2,b\n4,c\n"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.dl").write_text(".in\n.decl A(n: number, s: string) .input A.csv\n.out\n.decl R(s: string, n: number)\n.decl Empty(n: number)\n.rule\nR(s, n * 2) :- A(n, s).\nEmpty(n) :- A(n, _), n > 9.\n")
    (tmp_path / "A.csv").write_text('2;"x,y"\n1;\n')
    args = parse_args(["-p", str(tmp_path / "p.dl"), "-f", str(tmp_path), "-c", str(tmp_path / "out"), "-d", ";", "-O", "3", "-w", "2", "--fat-mode", "--no-sharing"])
    assert (args.program_name(), args.level, args.no_sharing, args.stream) == ("p", 3, True, False)
    assert run_batch(spark, args) == {"R": 2}
    assert (tmp_path / "out/csvs/R.csv").read_text() == '"",2\n"x,y",4\n' and (tmp_path / "out/size.txt").read_text() == "R: 2\n"
    shown = []
    run_batch(spark, Args(args.program, args.facts, delimiter=";"), shown.append)
    assert shown == ['R: "",2', 'R: "x,y",4']
    lines = []
    run_streaming(spark, Args(args.program, args.facts, delimiter=";", stream=True), ['- A 2;"x,y"'], lines.append)
    assert lines == ['+1\tR\t"",2', '+1\tR\t"x,y",4', '-1\tR\t"x,y",4']
    assert "step 0" in run_inspect(args.program) and '"strata"' in run_inspect(args.program, True)
    assert main(["inspect", args.program]) == 0 and "2 relations in" not in (shown := capsys.readouterr().out) and "R(s, n * 2)" in shown
    for bad in (["-p", "x"], ["-p", "x", "-f", "y", "-O", "4"], ["-p", "x", "-f", "y", "-w", "0"]):
        with pytest.raises(SystemExit):
            parse_args(bad)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["name", "cents"] and got.where(F.col("cents") > 0).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_epochs_keep_what_their_rounds_read(spark, monkeypatch):
    """A round reads states that are kept, and known rows dealt once when they are many; the result is a batch's."""
    from lodestrata.plans import fixpoint

    text = ".in\n.decl Graph(a: number, b: number)\n.out\n.decl T(a: number, b: number)\n.rule\nT(a, b) :- Graph(a, b). T(a, c) :- T(a, b), Graph(b, c)."
    graph = spark.createDataFrame([(a, a * k // 7) for a in range(1, 60) for k in (3, 5, 8)], "a long, b long")
    monkeypatch.setattr(fixpoint, "KEEP_FROM", 2)
    rule_rows, keep, seen, dealt = Engine.rule_rows, fixpoint.Total._keep, [], []

    def spied(self, analysis, rule, env, bag, sources=None):
        if sources and any(rule.atoms[i].name == "T" for i in sources):
            seen.append(env["Graph"].storageLevel.useMemory)
        return rule_rows(self, analysis, rule, env, bag, sources)

    monkeypatch.setattr(Engine, "rule_rows", spied)
    monkeypatch.setattr(fixpoint.Total, "_keep", lambda self, rows: dealt.append(self.known is not None and rows is self.known) or keep(self, rows))
    session = Session(spark, text, {"Graph": graph.where("a % 2 = 0")})
    session.advance()
    session.update_df("Graph", graph.where("a % 2 = 1"))
    session.advance()
    session.update_df("Graph", graph.where("a % 5 = 3").withColumn(MULT, F.lit(-1).cast("long")))
    session.advance()
    assert len(seen) > 5 and all(seen)
    assert dealt.count(True) == 2
    left = graph.where("a % 5 != 3")
    assert sorted(map(tuple, session.relation("T").collect())) == sorted(map(tuple, Engine(spark).run(text, {"Graph": left})["T"].collect()))
