"""More registered queries: files, the multiset library's smaller parts, stores, links and the protocol, over whole tables."""

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.types import ColumnType, register_type
from .operators import zset as z
from .operators.zset import ZSet
from .plans.ast import Arith, Atom, Attribute, Const, Head, Placeholder, Program, RelDecl, Rule, Var, program_to_dl
from .plans.durable import shared_base
from .plans.executor import Engine
from .plans.inspect import inspect_json
from .plans.parser import parse_program
from .queries import library, program_text, relations
from .sources.files import default_path, merge_partitions, read_number_lines, read_numbers, read_relation, write_csv_file, write_csv_folder, write_sizes
from .sources.tables import parquet
from .streaming.protocol import run_stream
from .streaming.session import Session
from .streaming.store import Store
from .streaming.sync import SyncLink


def _folder(spark: SparkSession) -> str:
    return f"{shared_base(spark)}/files-{uuid.uuid4().hex}"


CUSTOMER = RelDecl("Customer", (Attribute("c", "number"), Attribute("k", "number"), Attribute("seg", "string")))


@library("facts_sharded", "SELECT c, k, seg FROM cust WHERE c % 3 <> 2")
def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """A relation's file under its default name, with another delimiter, read by two of three workers."""
    base = _folder(spark)
    relations(spark, folder)["Customer"].select(F.concat_ws("^", "c0", "c1", "c2")).write.text(f"{base}/{default_path(CUSTOMER)}")
    return read_relation(spark, CUSTOMER, base, "^", 0, 3).unionAll(read_relation(spark, CUSTOMER, base, "^", 1, 3)).toDF("c", "k", "seg")


@library("numbers_scan", "SELECT c, k FROM cust")
def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers with empty cells at the ends of lines."""
    base = _folder(spark)
    relations(spark, folder)["Customer"].select(F.concat(F.concat_ws("]", "c0", "c1"), F.lit("]]"))).write.text(base)
    return read_numbers(spark, base, 2, "]").toDF("c", "k")


@library("csv_file_sink", "SELECT k, name, region FROM nat")
def _csv_file(spark: SparkSession, folder: str) -> DataFrame:
    """The sink of one file, and its numbers of rows; the driver writes and reads the file, so it may be local."""
    with tempfile.TemporaryDirectory() as place:
        write_csv_file(relations(spark, folder)["Nation"], f"{place}/csvs/Nation.csv")
        lines = read_number_lines(f"{place}/csvs/Nation.csv")
    cells = F.split("value", ",")
    return spark.createDataFrame([(x,) for x in lines], "value string").select(cells[0].cast("long").alias("k"), cells[1].alias("name"), cells[2].cast("long").alias("region"))


@library("size_report", "SELECT 'Big' AS name, count(*) AS n FROM cust WHERE k > 5 UNION ALL SELECT 'Seg', count(DISTINCT seg) FROM cust")
def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes of the output relations that have rows; None has none and isn't reported."""
    text = program_text(["Customer"], ["Big(c: number)", "Seg(seg: string)", "None(c: number)"], "Big(c) :- Customer(c, k, _), k > 5. Seg(s) :- Customer(_, _, s). None(c) :- Customer(c, k, _), k < 0.")
    out = Engine(spark).run(text, {"Customer": relations(spark, folder)["Customer"]})
    with tempfile.TemporaryDirectory() as place:
        write_sizes({name: rows.count() for name, rows in out.items()}, f"{place}/size.txt")
        lines = read_number_lines(f"{place}/size.txt")
    return spark.createDataFrame([(line.split(": ")[0], int(line.split(": ")[1])) for line in lines], "name string, n long")


@library("command_line", "SELECT 'file' AS kind, name, CAST(count(*) AS BIGINT) AS n FROM nat JOIN sup USING (k) GROUP BY name UNION ALL SELECT 'size', 'R', (SELECT count(DISTINCT name) FROM nat JOIN sup USING (k)) UNION ALL SELECT 'shown', 'R', (SELECT count(DISTINCT name) FROM nat JOIN sup USING (k))")
def _command_line(spark: SparkSession, folder: str) -> DataFrame:
    """A program file over a folder of facts, dealt to three workers: the file that .output names, size.txt, and what is
    printed without a folder for results."""
    from pathlib import Path

    from .cli import Args, run_batch

    base, have = _folder(spark), relations(spark, folder)
    for name, columns in (("Nation", ["c0", "c1"]), ("Supplier", ["c0", "c1"])):
        have[name].select(F.concat_ws(";", *columns)).write.text(f"{base}/{name}.facts")
    with tempfile.TemporaryDirectory() as place:
        Path(place, "p.dl").write_text(".in\n.decl Nation(k: number, name: string)\n.decl Supplier(s: number, k: number)\n.out\n.decl R(name: string, n: number) .output counts.csv\n.rule\nR(x, count(s)) :- Supplier(s, k), Nation(k, x).\n")
        args = Args(f"{place}/p.dl", base, f"{place}/out", ";", workers=3)
        run_batch(spark, args)
        cells = [line.split(",") for line in read_number_lines(f"{place}/out/csvs/counts.csv")]
        sizes = [line.split(": ") for line in read_number_lines(f"{place}/out/size.txt")]
        shown: list[str] = []
        run_batch(spark, Args(f"{place}/p.dl", base, delimiter=";"), shown.append)
    rows = [("file", name, int(n)) for name, n in cells] + [("size", name, int(n)) for name, n in sizes] + [("shown", "R", len(shown))]
    return spark.createDataFrame(rows, "kind string, name string, n long")


@library("csv_parts_merged", "SELECT s, k FROM sup")
def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of part files, joined to one; where the folder isn't a local one, its parts are read as they are."""
    base = _folder(spark)
    write_csv_folder(relations(spark, folder)["Supplier"].repartition(3), base)
    if os.path.isdir(base):
        with tempfile.NamedTemporaryFile() as whole:
            merge_partitions(base, whole.name)
            lines = spark.createDataFrame([(x,) for x in read_number_lines(whole.name)], "value string")
    else:
        lines = spark.read.text(base)
    cells = F.split("value", ",")
    return lines.select(cells[0].cast("long").alias("s"), cells[1].cast("long").alias("k"))


def _t(spark: SparkSession, folder: str, name: str, *columns: str) -> ZSet:
    return ZSet(parquet(spark, folder, name).selectExpr(*columns))


@library("zset_rekey", "SELECT k // 5 AS key, count(*) AS n FROM cust GROUP BY 1")
def _rekey(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "customer", "c_custkey AS c", "cast(c_nationkey as long) AS k").key_by(F.col("c") % 10).rekey(F.expr("k div 5"))
    return rows.count("key").rows().toDF("key", "n")


@library("zset_pipe_tap", "SELECT seg, count(*) AS n FROM cust WHERE k > 3 GROUP BY seg")
def _pipe(spark: SparkSession, folder: str) -> DataFrame:
    """Steps in a pipe; what a tap sees is what passes on."""
    seen: list[DataFrame] = []
    rows = _t(spark, folder, "customer", "c_mktsegment AS seg", "cast(c_nationkey as long) AS k")
    rows.pipe(lambda x: x.filter("k > 3"), lambda x: x.unkey("k"), lambda x: x.tap(seen.append))
    return ZSet(seen[0]).count("seg").rows().toDF("seg", "n")


@library("zset_output_callback", "SELECT r_regionkey AS r, r_name AS name, CAST(1 AS BIGINT) AS n FROM region")
def _output(spark: SparkSession, folder: str) -> DataFrame:
    got: list[tuple] = []
    _t(spark, folder, "region", "r_regionkey AS r", "r_name AS name").output(lambda row, n: got.append((row["r"], row["name"], n)))
    return spark.createDataFrame(got, "r int, name string, n long")


@library("zset_observe_debug", "SELECT 'shown' AS what, count(*) AS n FROM region UNION ALL SELECT 'size', count(*) FROM sup")
def _observed(spark: SparkSession, folder: str) -> DataFrame:
    lines: list[str] = []
    _t(spark, folder, "region", "r_regionkey AS r").debug("region", show=lines.append)
    return spark.createDataFrame([("shown", len(lines)), ("size", _t(spark, folder, "supplier", "s_suppkey AS s").observe("suppliers").size())], "what string, n long")


@library("zset_json_round_trip", "SELECT k, name, CAST(count(*) AS BIGINT) AS n FROM nat JOIN sup USING (k) GROUP BY k, name")
def _json(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as [row, multiplicity] texts and back."""
    nations = _t(spark, folder, "nation", "cast(n_nationkey as long) AS k", "n_name AS name").filter_by(_t(spark, folder, "supplier", "cast(s_nationkey as long) AS k"), "k")
    texts = [r.value for r in nations.to_json().toLocalIterator()]
    return ZSet.from_json(spark, texts, "k long, name string").df.withColumnRenamed(z.MULT, "n")


@library("topk_state", "SELECT c, o FROM (SELECT c, o, row_number() OVER (PARTITION BY c ORDER BY o) r FROM ord WHERE status <> 'O') WHERE r <= 2")
def _topk_state(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose net number isn't positive take no place; what is taken away once and put back does."""
    orders = _t(spark, folder, "orders", "o_custkey AS c", "o_orderkey AS o", "o_orderstatus AS status")
    rows = orders.concat(orders.filter("status = 'O'").negate(), orders.filter("status = 'F'").negate(), orders.filter("status = 'F'"))
    return rows.top_k("c", [F.asc("o")], limit=2).rows().select("c", "o")


@library("orderby_default", "SELECT k, s FROM sup ORDER BY k, s LIMIT 12")
def _default_order(spark: SparkSession, folder: str) -> DataFrame:
    """Without an order: by all columns, ascending."""
    return _t(spark, folder, "supplier", "cast(s_nationkey as long) AS k", "s_suppkey AS s").order_by([], limit=12).df.drop(z.MULT)


@library("snapshot_order", "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS place FROM nat WHERE region = 2")
def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A store's snapshot of a derived relation comes in order, and its listener is told once for a flush."""
    store = Store(spark, program_text(["Nation"], ["R(name: string)"], "R(n) :- Nation(_, n, 2)."))
    calls: list[int] = []
    store.subscribe("R", lambda: calls.append(1))
    store.update_df("Nation", relations(spark, folder)["Nation"])
    rows = store.snapshot("R")
    assert calls == [1]
    return spark.createDataFrame([(r[0], n) for n, r in enumerate(rows)], "name string, place long")


@library("column_type_date", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P'")
def _dates(spark: SparkSession, folder: str) -> DataFrame:
    """A registered column type in a program."""
    register_type(ColumnType("day", T.DateType(), str))
    days = parquet(spark, folder, "orders").selectExpr("o_orderstatus", "cast(o_orderdate as date)")
    return Engine(spark).run('.in .decl A(s: string, d: day) .out .decl R(day: day) .rule R(d) :- A("P", d).', {"A": days})["R"]


@library("literal_signs", "SELECT id, -5 - value AS a, value - -3 AS b FROM (SELECT DISTINCT id, value FROM ev) WHERE value > -100000")
def _signs(spark: SparkSession, folder: str) -> DataFrame:
    text = program_text(["Events"], ["R(id: number, a: number, b: number)"], "R(id, -5 - value, value - -3) :- Events(id, _, _, value), value > -100000.")
    return Engine(spark).run(text, {"Events": relations(spark, folder)["Events"]})["R"]


@library("zset_custom_aggregate", "SELECT k, CAST(sum(c * c) AS DOUBLE) AS squares FROM cust GROUP BY k")
def _custom(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate of one's own, as a grouped pandas function of values and multiplicities."""

    @F.pandas_udf("double")
    def squares(values: pd.Series, mult: pd.Series) -> float:
        return float((values * values * mult).sum())

    rows = _t(spark, folder, "customer", "cast(c_nationkey as long) AS k", "c_custkey AS c")
    grouped = rows.df.groupBy("k").agg(squares(F.col("c"), F.col(z.MULT)).alias("squares"))
    return ZSet(grouped).rows()


@library("index_mass", "SELECT k, CAST(count(*) FILTER (WHERE s % 4 <> 1) - count(*) FILTER (WHERE s % 4 = 1) AS BIGINT) AS mass, count(*) AS entries FROM sup GROUP BY k")
def _mass(spark: SparkSession, folder: str) -> DataFrame:
    """Net mass and entries of each key of an indexed multiset."""
    rows = _t(spark, folder, "supplier", "s_suppkey AS s", "cast(s_nationkey as long) AS k")
    return rows.filter("s % 4 <> 1").concat(rows.filter("s % 4 = 1").negate()).index("k").masses().df.select("k", "mass", "entries")


@library("index_get", "SELECT k, s FROM sup WHERE k IN (SELECT k FROM nat WHERE region = 3)")
def _get(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of an index under some keys."""
    index = _t(spark, folder, "supplier", "cast(s_nationkey as long) AS k", "s_suppkey AS s").index("k")
    keys = parquet(spark, folder, "nation").where("n_regionkey = 3").selectExpr("cast(n_nationkey as long) AS k")
    return index.get(keys).rows().select("k", "s")


@library("program_by_hand", "SELECT DISTINCT k, 'some' AS kind FROM sup")
def _by_hand(spark: SparkSession, folder: str) -> DataFrame:
    """A program built as values, written as text and read again."""
    supplier = RelDecl("Supplier", (Attribute("s", "number"), Attribute("k", "number")))
    head = Head("R", (Arith(Var("k")), Arith(Const("some"))))
    built = Program((supplier,), (RelDecl("R", (Attribute("k", "number"), Attribute("kind", "string"))),), (Rule(head, (Atom("Supplier", (Placeholder(), Var("k"))),)),))
    return Engine(spark).run(parse_program(program_to_dl(built)), {"Supplier": relations(spark, folder)["Supplier"]})["R"]


_REGIONS = program_text(["Nation"], ["N(g: number, n: number)"], "N(g, count(k)) :- Nation(k, _, g).")


@library("stream_protocol", "SELECT '+1\t' || 'N\t' || region || ',' || count(*) AS line FROM nat GROUP BY region")
def _protocol(spark: SparkSession, folder: str) -> DataFrame:
    """Changes as lines and the lines that come back: a row that comes and goes in one step is netted, a bad line changes
    nothing, and the end of input is a last step."""
    rows = [tuple(r) for r in relations(spark, folder)["Nation"].orderBy("c0").toLocalIterator()]
    lines = [f"+ Nation {k},{name},{g}" for k, name, g in rows]
    out: list[str] = []
    run_stream(Session(spark, _REGIONS), [*lines[:5], "# note", "+ Nation 99,Nowhere,9", "- Nation 99,Nowhere,9", *lines[5:]], out.append)
    return spark.createDataFrame([(x,) for x in out], "line string")


@library("stream_steps", "SELECT region AS g, count(*) AS n, count(*) FILTER (WHERE k < 10) AS first FROM nat GROUP BY region HAVING count(*) FILTER (WHERE k < 10) > 0")
def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Initial facts, then a first step, then additions, then close: the counts after both."""
    nations = relations(spark, folder)["Nation"]
    session = Session(spark, _REGIONS, {"Nation": nations.where("c0 < 10")})
    first = session.advance()["N"].where(F.col(z.MULT) > 0).select("g", F.col("n").alias("first"))
    session.update_df("Nation", nations.where("c0 >= 10"))
    session.close()
    return session.relation("N").join(first, "g").select("g", "n", "first")


@library("link_two_stores", "SELECT 'left' AS side, k, name, region FROM nat UNION ALL SELECT 'right', k, name, region FROM nat")
def _link(spark: SparkSession, folder: str) -> DataFrame:
    """Two stores that each get half of the rows, one of them offline for a while; one row is put in twice and taken back once."""
    text = program_text(["Nation"], ["R(k: number, name: string, g: number)"], "R(k, n, g) :- Nation(k, n, g).")
    left, right = Store(spark, text), Store(spark, text)
    link = SyncLink(left, right, ["Nation"], delay=1)
    rows = [tuple(r) for r in relations(spark, folder)["Nation"].toLocalIterator()]
    for k, name, g in rows[::2]:
        left.update("Nation", (k, name, g))
    link.online = False
    link.tick(2)
    for k, name, g in rows[1::2]:
        right.update("Nation", (k, name, g))
    left.update("Nation", rows[0])
    left.update("Nation", rows[0], -1)
    link.online = True
    link.tick(2)
    sides = [store.relation("R").toDF("k", "name", "region").select(F.lit(side).alias("side"), "k", "name", "region") for side, store in (("left", left), ("right", right))]
    return sides[0].unionAll(sides[1])


@library("inspect_strata", "SELECT * FROM (VALUES (0, false, 'HasParent'), (1, false, 'Ready'), (2, true, 'Ready')) AS t(step, recursive, heads)")
def _strata(spark: SparkSession, folder: str) -> DataFrame:
    """The steps that a report lists of a program over the tables."""
    import json

    text = program_text(["Tree"], ["Ready(c: number)"], "HasParent(c) :- Tree(c, _). Ready(p) :- Tree(_, p), !HasParent(p). Ready(c) :- Ready(p), Tree(c, p).")
    steps = json.loads(inspect_json(text))["plan"]
    return spark.createDataFrame([(n, s["recursive"], ",".join(s["heads"])) for n, s in enumerate(steps)], "step int, recursive boolean, heads string")
