"""The registered queries over the star schema, and the DuckDB SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import zset as z
from .operators.window import MovableWindow
from .operators.zset import ZSet
from .plans.executor import Engine
from .plans.durable import shared_base
from .plans.fixpoint import fixpoint
from .plans.parser import parse_program
from .sources.files import parse_lines, write_csv_folder
from .sources.tables import bind, parquet, warehouse
from .streaming.session import Session
from .streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]

RELATIONS = {
    "Region": "Region(r: number, name: string)",
    "Nation": "Nation(k: number, name: string, region: number)",
    "Customer": "Customer(c: number, k: number, seg: string)",
    "Supplier": "Supplier(s: number, k: number)",
    "Part": "Part(p: number, brand: string, type: string, size: number)",
    "Orders": "Orders(o: number, c: number, status: string, prio: string)",
    "Lineitem": "Lineitem(o: number, p: number, s: number, qty: number, cents: number)",
    "Events": "Events(id: number, user: number, type: string, value: number)",
    "Conv": "Conv(conv: number, turn: number, role: string)",
    "Tree": "Tree(child: number, parent: number)",
    "Graph": "Graph(a: number, b: number)",
    "Road": "Road(a: number, b: number, w: number)",
}

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The relations in SQL, for oracles.
_SQL = """
WITH nat AS (SELECT CAST(n_nationkey AS BIGINT) k, n_name AS name, CAST(n_regionkey AS BIGINT) region FROM nation),
cust AS (SELECT c_custkey c, CAST(c_nationkey AS BIGINT) k, c_mktsegment seg FROM customer),
sup AS (SELECT s_suppkey s, CAST(s_nationkey AS BIGINT) k FROM supplier),
par AS (SELECT p_partkey p, p_brand brand, p_type AS type, CAST(p_size AS BIGINT) size FROM part),
ord AS (SELECT o_orderkey o, o_custkey c, o_orderstatus status, o_orderpriority prio FROM orders),
li AS (SELECT l_orderkey o, l_partkey p, l_suppkey s, CAST(l_quantity AS BIGINT) qty, CAST(round(l_extendedprice * 100) AS BIGINT) cents FROM lineitem),
ev AS (SELECT event_id id, user_id AS "user", event_type AS type, CAST(round(value * 100) AS BIGINT) AS value FROM events),
conv AS (SELECT conv_id conv, turn, role FROM conversations),
tree AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey >= 3),
graph AS (SELECT p_partkey AS a, p_partkey * p_size // 50 AS b FROM part UNION ALL SELECT p_partkey // 2, p_partkey FROM part WHERE p_size = 1),
road AS (SELECT p_partkey AS a, p_partkey // 2 AS b, CAST(p_size % 9 + 1 AS BIGINT) AS w FROM part UNION ALL SELECT p_partkey // 2, p_partkey, CAST(p_size % 7 + 1 AS BIGINT) FROM part UNION ALL SELECT p_partkey, p_partkey * p_size // 50, 2 FROM part),
up AS (SELECT s + 1000 AS x, k + 100 AS y FROM sup UNION SELECT k + 100, region FROM nat)
"""


def relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The star schema's relations, and graphs over whole keys that grow with it: Graph leads from each part to a smaller one,
    and back for some, so it has cycles; Road leads both ways between a part and its half, and along Graph."""
    part = parquet(spark, folder, "part")
    down = bind(part, "p_partkey", "p_partkey * p_size div 50")
    return {
        **warehouse(spark, folder),
        "Tree": bind(parquet(spark, folder, "customer").where("c_custkey >= 3"), "c_custkey", "c_custkey div 3"),
        "Graph": down.unionAll(bind(part.where("p_size = 1"), "p_partkey div 2", "p_partkey")),
        "Road": bind(part, "p_partkey", "p_partkey div 2", "cast(p_size % 9 + 1 as long)").unionAll(bind(part, "p_partkey div 2", "p_partkey", "cast(p_size % 7 + 1 as long)")).unionAll(bind(part, "p_partkey", "p_partkey * p_size div 50", "2L")),
    }


def program_text(inputs: list[str], outputs: list[str], rules: str) -> str:
    return "\n".join([".in", *(f".decl {RELATIONS.get(i, i)}" for i in inputs), ".out", *(f".decl {o}" for o in outputs), ".rule", rules])


def datalog(name: str, inputs: str, outputs: str, rules: str, sql: str | None, level: int | None = None, result: str | None = None) -> None:
    """Registers a query: the named result relation of a program (by default the last one declared)."""
    outs = [o.strip() for o in outputs.split(";")]
    text, wanted = program_text(inputs.split(), outs, rules), result or outs[-1].split("(")[0]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        have = relations(spark, folder)
        return Engine(spark, level).run(text, {n: have[n] for n in inputs.split()})[wanted]

    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = _SQL + sql


def library(name: str, sql: str | None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = _SQL + sql
        return function

    return register


# Projection, filter, predicates

datalog("proj_filter_const", "Orders", "R(o: number)", 'R(o) :- Orders(o, _, "F", _).', "SELECT DISTINCT o FROM ord WHERE status = 'F'")
datalog("filter_compare_arith", "Lineitem", "R(o: number, p: number)", "R(o, p) :- Lineitem(o, p, _, qty, _), qty * 2 + 1 > 60, p + qty * 2 % 7 = 3.", "SELECT DISTINCT o, p FROM li WHERE qty * 2 + 1 > 60 AND ((p + qty) * 2) % 7 = 3")
datalog("filter_strings", "Customer", "R(c: number)", 'R(c) :- Customer(c, _, seg), seg >= "FURNITURE", seg != "MACHINERY".', "SELECT DISTINCT c FROM cust WHERE seg >= 'FURNITURE' AND seg <> 'MACHINERY'")
datalog("repeated_var", "Graph", "R(x: number)", "R(x) :- Graph(x, x).", "SELECT DISTINCT a AS x FROM graph WHERE a = b")
datalog("bool_literal", "Nation", "T(k: number); R(k: number)", "T(k) :- Nation(k, _, _), False. R(k) :- Nation(k, _, _), True.", "SELECT DISTINCT k FROM nat")
datalog("head_arith_trunc_div", "Lineitem", "R(o: number, a: number, b: number)", "R(o, qty * 10 / 7, 3 - qty / 4) :- Lineitem(o, _, _, qty, _).", "SELECT DISTINCT o, (qty * 10) // 7 AS a, CASE WHEN 3 - qty < 0 THEN -((qty - 3) // 4) ELSE (3 - qty) // 4 END AS b FROM li")
datalog("head_constant", "Customer", "R(c: number, kind: string, w: number)", 'R(c, "cust", 1) :- Customer(c, _, _).', "SELECT DISTINCT c, 'cust' AS kind, CAST(1 AS BIGINT) AS w FROM cust")
datalog("remainder_sign", "Events", "R(id: number, m: number)", "R(id, 0 - value % 7) :- Events(id, _, _, value).", "SELECT DISTINCT id, (0 - value) % 7 AS m FROM ev")

# Joins

datalog(
    "join_inner_4way",
    "Lineitem Orders Customer Nation",
    "R(name: string, status: string)",
    "R(name, status) :- Lineitem(o, _, _, qty, _), Orders(o, c, status, _), Customer(c, k, _), Nation(k, name, _), qty > 45.",
    "SELECT DISTINCT nat.name, ord.status FROM li JOIN ord USING (o) JOIN cust USING (c) JOIN nat USING (k) WHERE qty > 45",
)
datalog("join_self", "Supplier", "R(a: number, b: number)", "R(a, b) :- Supplier(a, k), Supplier(b, k), a < b.", "SELECT DISTINCT x.s AS a, y.s AS b FROM sup x JOIN sup y ON x.k = y.k AND x.s < y.s")
datalog("join_theta", "Region Nation", "R(r: number, k: number)", "R(r, k) :- Region(r, _), Nation(k, _, g), r * 2 + 1 > g, r < k.", "SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS r, k FROM region, nat WHERE r_regionkey * 2 + 1 > region AND r_regionkey < k")
datalog("join_cartesian", "Region Customer", "Seg(seg: string); R(name: string, seg: string)", "Seg(seg) :- Customer(_, _, seg). R(name, seg) :- Region(_, name), Seg(seg).", "SELECT DISTINCT r_name AS name, seg FROM region CROSS JOIN (SELECT DISTINCT seg FROM cust)")
datalog("join_triangle", "Road", "R(a: number, b: number, c: number)", "R(a, b, c) :- Road(a, b, _), Road(b, c, _), Road(c, a, _).", "SELECT DISTINCT x.a, x.b, y.b AS c FROM road x JOIN road y ON x.b = y.a JOIN road w ON y.b = w.a AND w.b = x.a")
datalog("semi_noncore", "Orders Customer", "N(k: number, n: number); R(o: number, c: number)", "N(k, count(o)) :- Orders(o, c, _, _), Customer(c, k, _). R(o, c) :- Orders(o, c, _, _), Customer(c, _, _).", "SELECT DISTINCT o, c FROM ord WHERE EXISTS (SELECT 1 FROM cust WHERE cust.c = ord.c)")
datalog("semi_noncore_bag", "Lineitem Orders", "R(status: string, n: number)", "R(status, count(o)) :- Lineitem(o, _, _, _, _), Orders(o, _, status, _).", "SELECT status, count(*) AS n FROM li JOIN ord USING (o) GROUP BY status")
datalog("anti_single", "Customer Tree", "R(c: number)", "R(c) :- Customer(c, _, _), !Tree(_, c).", "SELECT DISTINCT c FROM cust WHERE NOT EXISTS (SELECT 1 FROM tree WHERE tree.parent = cust.c)")
datalog(
    "anti_span_join",
    "Supplier Customer Lineitem Orders Nation",
    "Sold(s: number, c: number); R(s: number, c: number)",
    "Sold(s, c) :- Lineitem(o, _, s, _, _), Orders(o, c, _, _). R(s, c) :- Supplier(s, k), Customer(c, k, _), Nation(k, _, 1), !Sold(s, c).",
    "SELECT DISTINCT s, c FROM sup JOIN cust USING (k) JOIN nat USING (k) WHERE region = 1 AND NOT EXISTS (SELECT 1 FROM li JOIN ord ON li.o = ord.o WHERE li.s = sup.s AND ord.c = cust.c)",
)
datalog("anti_const_placeholder", "Customer Orders", "R(c: number)", 'R(c) :- Customer(c, _, "BUILDING"), !Orders(_, c, "F", _).', "SELECT DISTINCT c FROM cust WHERE seg = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM ord WHERE ord.c = cust.c AND status = 'F')")
datalog("exists_guard", "Nation Region", "R(k: number); Q(k: number)", "R(k) :- Nation(k, _, _), Region(9, _). Q(k) :- Nation(k, _, _), Region(_, _), !Region(9, _).", "SELECT DISTINCT k FROM nat WHERE EXISTS (SELECT 1 FROM region) AND NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 9)")

# Aggregates

datalog("agg_count_bag", "Lineitem", "R(o: number, n: number)", "R(o, count(p)) :- Lineitem(o, p, _, _, _).", "SELECT o, count(*) AS n FROM li GROUP BY o")
datalog("agg_sum", "Lineitem", "R(s: number, cents: number)", "R(s, sum(cents)) :- Lineitem(_, _, s, _, cents).", "SELECT s, CAST(sum(cents) AS BIGINT) AS cents FROM li GROUP BY s")
datalog("agg_min_max", "Lineitem", "Lo(p: number, v: number); Hi(p: number, v: number); R(p: number, lo: number, hi: number)", "Lo(p, min(qty)) :- Lineitem(_, p, _, qty, _). Hi(p, max(qty)) :- Lineitem(_, p, _, qty, _). R(p, a, b) :- Lo(p, a), Hi(p, b).", "SELECT p, min(qty) AS lo, max(qty) AS hi FROM li GROUP BY p")
datalog("agg_global", "Lineitem", "R(cents: number)", "R(sum(cents)) :- Lineitem(_, _, _, qty, cents), qty < 10.", "SELECT CAST(sum(cents) AS BIGINT) AS cents FROM li WHERE qty < 10")
datalog("agg_global_empty", "Lineitem", "R(n: number)", "R(count(o)) :- Lineitem(o, _, _, qty, _), qty < 0.", "SELECT count(*) AS n FROM li WHERE qty < 0 HAVING count(*) > 0")
datalog("agg_multi_rule", "Lineitem Orders", "R(o: number, n: number)", "R(o, count(c)) :- Orders(o, c, _, _). R(o, count(p)) :- Lineitem(o, p, _, _, _).", "SELECT o, count(*) AS n FROM (SELECT o FROM ord UNION ALL SELECT o FROM li) GROUP BY o")
datalog("agg_expr", "Lineitem", "R(s: number, v: number)", "R(s, sum(cents - 100 * qty)) :- Lineitem(_, _, s, qty, cents).", "SELECT s, CAST(sum((cents - 100) * qty) AS BIGINT) AS v FROM li GROUP BY s")
datalog("agg_group_expr", "Events", "R(g: number, kind: string, n: number)", "R(user % 10, kind, count(id)) :- Events(id, user, kind, _).", "SELECT \"user\" % 10 AS g, type AS kind, count(*) AS n FROM ev GROUP BY 1, 2")
datalog(
    "revenue_per_nation",
    "Lineitem Orders Customer Nation",
    "Rev(name: string, cents: number)",
    "Rev(n, sum(cents)) :- Lineitem(o, _, _, _, cents), Orders(o, c, _, _), Customer(c, k, _), Nation(k, n, _).",
    "SELECT nat.name, CAST(sum(cents) AS BIGINT) AS cents FROM li JOIN ord USING (o) JOIN cust USING (c) JOIN nat USING (k) GROUP BY nat.name",
)

# Sets

datalog("union_rules", "Customer Supplier", "R(k: number)", "R(k) :- Customer(_, k, \"BUILDING\"). R(k) :- Supplier(_, k).", "SELECT k FROM cust WHERE seg = 'BUILDING' UNION SELECT k FROM sup")
datalog("union_edb_idb", "Nation Graph", "R(a: number, b: number)", "Graph(k, g) :- Nation(k, _, g). R(a, b) :- Graph(a, b).", "SELECT a, b FROM graph UNION SELECT k, region FROM nat")
datalog("difference", "Customer Orders", "A(c: number); B(c: number); R(c: number)", 'A(c) :- Customer(c, _, _). B(c) :- Orders(_, c, "P", _). R(c) :- A(c), !B(c).', "SELECT c FROM cust EXCEPT SELECT c FROM ord WHERE status = 'P'")
datalog("intersection", "Customer Supplier", "R(k: number)", "R(k) :- Customer(_, k, \"MACHINERY\"), Supplier(_, k).", "SELECT k FROM cust WHERE seg = 'MACHINERY' INTERSECT SELECT k FROM sup")
datalog(
    "strata_negation_chain",
    "Tree",
    "HasParent(c: number); HasChild(c: number); Root(c: number); Leaf(c: number); Ready(c: number); R(c: number)",
    "HasParent(c) :- Tree(c, _). HasChild(p) :- Tree(_, p). Root(p) :- HasChild(p), !HasParent(p). Leaf(c) :- Tree(c, _), !HasChild(c). Ready(c) :- Root(c). Ready(c) :- Ready(p), Tree(c, p). R(c) :- Leaf(c), Ready(c).",
    "SELECT child AS c FROM tree WHERE child NOT IN (SELECT parent FROM tree)",
)

# Recursion


def _recursive(body: str, result: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {body} {result})"


datalog("tc_linear", "Tree", "R(a: number, d: number)", "R(p, c) :- Tree(c, p). R(a, d) :- R(a, x), Tree(d, x).", _recursive("t(a, d) AS (SELECT parent, child FROM tree UNION SELECT t.a, tree.child FROM t JOIN tree ON tree.parent = t.d)", "SELECT a, d FROM t"))
datalog("tc_nonlinear", "Graph", "R(a: number, b: number)", "R(a, b) :- Graph(a, b). R(a, c) :- R(a, b), R(b, c).", _recursive("t(a, b) AS (SELECT a, b FROM graph UNION SELECT t.a, graph.b FROM t JOIN graph ON graph.a = t.b)", "SELECT a, b FROM t"))
datalog("reach_seeded", "Supplier Graph", "R(x: number)", "R(b) :- Supplier(s, _), Graph(s, b). R(b) :- R(a), Graph(a, b).", _recursive("t(x) AS (SELECT graph.b FROM sup JOIN graph ON graph.a = sup.s UNION SELECT graph.b FROM t JOIN graph ON graph.a = t.x)", "SELECT x FROM t"))
datalog(
    "same_generation",
    "Supplier Nation",
    "Up(x: number, y: number); R(x: number, y: number)",
    "Up(s + 1000, k + 100) :- Supplier(s, k). Up(k + 100, g) :- Nation(k, _, g). R(x, y) :- Up(x, p), Up(y, p), x != y. R(x, y) :- Up(x, p), R(p, q), Up(y, q).",
    _recursive("t(x, y) AS (SELECT a.x, b.x FROM up a JOIN up b ON a.y = b.y WHERE a.x <> b.x UNION SELECT a.x, b.x FROM t JOIN up a ON a.y = t.x JOIN up b ON b.y = t.y)", "SELECT x, y FROM t"),
)
datalog(
    "mutual_recursion_even_odd",
    "Tree",
    "Even(c: number); Odd(c: number); R(c: number, kind: string)",
    'Even(p) :- Tree(_, p), p < 3. Odd(c) :- Even(p), Tree(c, p). Even(c) :- Odd(p), Tree(c, p). R(c, "even") :- Even(c). R(c, "odd") :- Odd(c).',
    _recursive("t(c, d) AS (SELECT parent, 0 FROM tree WHERE parent < 3 UNION SELECT tree.child, t.d + 1 FROM t JOIN tree ON tree.parent = t.c)", "SELECT DISTINCT c, CASE WHEN d % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM t"),
)
datalog("cc_min", "Graph", "R(n: number, c: number)", "R(n, min(n)) :- Graph(n, _). R(n, min(c)) :- R(o, c), Graph(o, n).", _recursive("t(n, c) AS (SELECT a, a FROM graph UNION SELECT graph.b, t.c FROM t JOIN graph ON graph.a = t.n)", "SELECT n, min(c) AS c FROM t GROUP BY n"))
datalog("sssp_min", "Road", "R(n: number, d: number)", "R(5, min(0)) :- Road(5, _, _). R(b, min(d + w)) :- R(a, d), Road(a, b, w).", _recursive("t(n, d) AS (SELECT DISTINCT a, CAST(0 AS BIGINT) FROM road WHERE a = 5 UNION SELECT road.b, t.d + road.w FROM t JOIN road ON road.a = t.n WHERE t.d + road.w <= 250)", "SELECT n, min(d) AS d FROM t GROUP BY n"))
datalog("recursive_max", "Tree", "R(c: number, d: number)", "R(c, max(0)) :- Tree(_, c), c < 3. R(c, max(d + 1)) :- R(p, d), Tree(c, p).", _recursive("t(c, d) AS (SELECT parent, CAST(0 AS BIGINT) FROM tree WHERE parent < 3 UNION SELECT tree.child, t.d + 1 FROM t JOIN tree ON tree.parent = t.c)", "SELECT c, max(d) AS d FROM t GROUP BY c"))
datalog(
    "conv_next_turn",
    "Conv",
    "Has(v: number, t: number); R(v: number, t: number)",
    'Has(v, t) :- Conv(v, t, _). R(v, t) :- Has(v, t), t = 0. R(v, t + 1) :- R(v, t), Conv(v, t, _).',
    _recursive("t(v, t) AS (SELECT conv, turn FROM conv WHERE turn = 0 UNION SELECT t.v, t.t + 1 FROM t JOIN conv ON conv.conv = t.v AND conv.turn = t.t)", "SELECT v, t FROM t"),
)


@library("iterate_generic", _recursive("t(n) AS (SELECT s FROM sup UNION SELECT graph.b FROM t JOIN graph ON graph.a = t.n)", "SELECT n FROM t"))
def _iterate(spark: SparkSession, folder: str) -> DataFrame:
    edges, seeds = relations(spark, folder)["Graph"], parquet(spark, folder, "supplier").select(F.col("s_suppkey").alias("n"))
    return fixpoint(seeds, lambda new: new.join(edges, F.col("n") == F.col("c0")).select(F.col("c1").alias("n")))


datalog(
    "recursion_three_heads",
    "Tree",
    "A(c: number); B(c: number); C(c: number); R(c: number, kind: string)",
    'A(p) :- Tree(_, p), p < 3. B(c) :- A(p), Tree(c, p). C(c) :- B(p), Tree(c, p). A(c) :- C(p), Tree(c, p). R(c, "a") :- A(c). R(c, "b") :- B(c). R(c, "c") :- C(c).',
    _recursive("t(c, d) AS (SELECT parent, 0 FROM tree WHERE parent < 3 UNION SELECT tree.child, t.d + 1 FROM t JOIN tree ON tree.parent = t.c)", "SELECT DISTINCT c, CASE d % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind FROM t"),
)

# Replicated data as programs: recursion over negation and over aggregates

#: A sequence kept as a tree whose siblings stand in the order of their keys, with members that were taken out: the place of
#: a member among those that are left is its parent's, and what its parent and its elder siblings' subtrees hold.
SEQUENCE_RULES = """
HasParent(c) :- Tree(c, _).
Top(p) :- Tree(_, p), !HasParent(p).
Live(c) :- Customer(c, _, seg), seg != "MACHINERY".
Within(p, p) :- Top(p). Within(c, c) :- Tree(c, _). Within(a, d) :- Within(a, x), Tree(d, x).
Holds(a, count(d)) :- Within(a, d), Live(d).
Elder(c, sum(n)) :- Tree(c, p), Tree(e, p), e < c, Holds(e, n).
Later(c) :- Elder(c, _).
Gap(c, n) :- Elder(c, n). Gap(c, 0) :- Tree(c, _), !Later(c).
Own(c, 1) :- Live(c). Own(c, 0) :- Within(c, c), !Live(c).
Place(r, r, 0) :- Top(r).
Place(r, c, x + w + n) :- Place(r, p, x), Tree(c, p), Own(p, w), Gap(c, n).
R(r, x, c) :- Place(r, c, x), Live(c).
"""
datalog(
    "sequence_order",
    "Tree Customer",
    "R(r: number, x: number, c: number)",
    SEQUENCE_RULES,
    _recursive(
        "t(r, c, path) AS (SELECT DISTINCT parent, parent, [parent] FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION ALL SELECT t.r, tree.child, list_append(t.path, tree.child) FROM t JOIN tree ON tree.parent = t.c)",
        "SELECT r, row_number() OVER (PARTITION BY r ORDER BY path) - 1 AS x, t.c FROM t JOIN cust ON cust.c = t.c AND seg <> 'MACHINERY'",
    ),
)
datalog(
    "register_values",
    "Orders",
    "Beaten(o: number); R(c: number, status: string, o: number)",
    "Beaten(o) :- Orders(o, c, s, _), Orders(q, c, s, _), q > o. R(c, s, o) :- Orders(o, c, s, _), !Beaten(o).",
    "SELECT c, status, max(o) AS o FROM ord GROUP BY c, status",
)
datalog(
    "delivery_held_back",
    "Tree Customer",
    "R(c: number)",
    'Held(c) :- Customer(c, _, "BUILDING"). HasParent(c) :- Tree(c, _). R(p) :- Tree(_, p), !HasParent(p). R(c) :- R(p), Tree(c, p), !Held(c).',
    _recursive("t(c) AS (SELECT parent FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION SELECT tree.child FROM t JOIN tree ON tree.parent = t.c WHERE tree.child NOT IN (SELECT c FROM cust WHERE seg = 'BUILDING'))", "SELECT c FROM t"),
)


# The multiset library


def _t(spark: SparkSession, folder: str, name: str, *columns: str) -> ZSet:
    return ZSet(parquet(spark, folder, name).selectExpr(*columns))


def _customers(spark: SparkSession, folder: str) -> ZSet:
    return _t(spark, folder, "customer", "c_custkey AS c", "c_mktsegment AS seg")


def _orders(spark: SparkSession, folder: str) -> ZSet:
    return _t(spark, folder, "orders", "o_custkey AS c", "o_orderkey AS o", "o_orderstatus AS status").filter("status = 'F'")


for _how, _sql in (("left", "SELECT c, seg, o, status FROM cust LEFT JOIN x USING (c)"), ("right", "SELECT c, seg, o, status FROM (SELECT * FROM cust WHERE seg <> 'BUILDING') RIGHT JOIN x USING (c)"), ("full", "SELECT c, seg, o, status FROM (SELECT * FROM cust WHERE seg <> 'BUILDING') FULL JOIN x USING (c)"), ("inner", "SELECT c, seg, o, status FROM cust JOIN x USING (c)")):

    def _joined(spark: SparkSession, folder: str, how: str = _how) -> DataFrame:
        left = _customers(spark, folder)
        left = left.filter("seg != 'BUILDING'") if how in ("right", "full") else left
        return getattr(left, f"{how}_join")(_orders(spark, folder), "c").rows().select("c", "seg", "o", "status")

    library(f"zset_{_how}_join", f", x AS (SELECT c, o, status FROM ord WHERE status = 'F') {_sql}")(_joined)


@library("zset_anti_join", "SELECT c, seg FROM cust WHERE c NOT IN (SELECT c FROM ord WHERE status = 'F')")
def _anti(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder).anti_join(_orders(spark, folder), "c").rows()


@library("zset_filter_by", "SELECT c, seg, count(*) AS n FROM cust JOIN ord USING (c) WHERE status = 'F' GROUP BY c, seg")
def _filter_by(spark: SparkSession, folder: str) -> DataFrame:
    return _customers(spark, folder).filter_by(_orders(spark, folder), "c").df.withColumnRenamed(z.MULT, "n")


@library("zset_join_delta", "SELECT c, seg, o, status FROM cust JOIN ord USING (c) WHERE status = 'F' EXCEPT SELECT c, seg, o, status FROM cust JOIN ord USING (c) WHERE status = 'F' AND c % 5 <> 0 AND o % 6 <> 0")
def _delta(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _customers(spark, folder), _orders(spark, folder)
    return ZSet.join_delta(left.filter("c % 5 <> 0"), left.filter("c % 5 = 0"), right.filter("o % 6 <> 0"), right.filter("o % 6 = 0"), "c").rows().select("c", "seg", "o", "status")


def _lines(spark: SparkSession, folder: str) -> ZSet:
    return _t(spark, folder, "lineitem", "l_returnflag AS flag", "l_linestatus AS st", "cast(l_quantity as long) AS qty", "cast(round(l_extendedprice * 100) as long) AS cents")


_LINES = ", x AS (SELECT l_returnflag flag, l_linestatus st, CAST(l_quantity AS BIGINT) qty, CAST(round(l_extendedprice * 100) AS BIGINT) cents FROM lineitem) "


@library("zset_groupby_multi", _LINES + "SELECT flag, st, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n, min(qty) AS lo, max(qty) AS hi FROM x GROUP BY flag, st")
def _groupby(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).group_by(["flag", "st"], total=z.total("cents"), n=z.rows_count(), lo=z.minimum("qty"), hi=z.maximum("qty")).rows()


@library("zset_avg", _LINES + "SELECT flag, sum(qty) / count(qty) AS mean FROM x GROUP BY flag")
def _avg(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).group_by("flag", mean=z.average("qty")).rows()


@library("zset_median", _LINES + "SELECT flag, median(CAST(cents AS DOUBLE)) AS middle FROM x GROUP BY flag")
def _median(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).group_by("flag", middle=z.median("cents")).rows()


@library("zset_mode", _LINES + "SELECT flag, qty AS most FROM (SELECT flag, qty, row_number() OVER (PARTITION BY flag ORDER BY count(*) DESC, qty) r FROM x GROUP BY flag, qty) WHERE r = 1")
def _mode(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).group_by("flag", most=z.mode("qty")).rows()


@library("zset_count_nonnull", "SELECT status, count(seg) AS n FROM (SELECT status, CASE WHEN c % 3 = 0 THEN seg END AS seg FROM ord JOIN cust USING (c)) GROUP BY status")
def _nonnull(spark: SparkSession, folder: str) -> DataFrame:
    rows = parquet(spark, folder, "orders").join(parquet(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_orderstatus AS status", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS seg")
    return ZSet(rows).group_by("status", n=z.count("seg")).rows()


@library("zset_distinct_by", "SELECT k, min(c) AS c FROM cust GROUP BY k")
def _distinct_by(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "customer", "cast(c_nationkey as long) AS k", "c_custkey AS c").distinct("k").rows()


@library("zset_consolidate", "SELECT o, p, count(*) AS n FROM li GROUP BY o, p HAVING count(*) > 1")
def _consolidate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "lineitem", "l_orderkey AS o", "l_partkey AS p")
    return rows.concat(rows.distinct().negate()).consolidate().df.selectExpr("o", "p", f"{z.MULT} + 1 AS n")


@library("zset_negate_concat", "SELECT o, count(*) AS n FROM li WHERE o % 2 = 0 GROUP BY o")
def _negate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "lineitem", "l_orderkey AS o")
    return rows.concat(rows.filter("o % 2 = 1").negate()).consolidate().df.withColumnRenamed(z.MULT, "n")


@library("zset_reduce", _LINES + "SELECT flag, CAST(sum(qty) AS BIGINT) AS total, count(DISTINCT qty) AS kinds FROM x GROUP BY flag")
def _reduce(spark: SparkSession, folder: str) -> DataFrame:
    import pandas as pd

    def per_key(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"flag": rows.flag.iloc[:1], "total": int((rows.qty * rows[z.MULT]).sum()), "kinds": int(rows.qty.nunique()), z.MULT: 1})

    return _lines(spark, folder).map("flag", "qty").reduce("flag", per_key, "flag string, total long, kinds long").rows()


@library("zset_intersect", "SELECT k FROM cust INTERSECT SELECT k FROM sup")
def _intersect(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "customer", "cast(c_nationkey as long) AS k").intersect(_t(spark, folder, "supplier", "cast(s_nationkey as long) AS k")).rows()


@library("except_all_distinct", "SELECT DISTINCT k FROM (SELECT k FROM cust EXCEPT ALL SELECT k FROM sup)")
def _except(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "customer", "cast(c_nationkey as long) AS k").subtract(_t(spark, folder, "supplier", "cast(s_nationkey as long) AS k")).rows()


@library("zset_min_by_key", "SELECT s, min(qty) AS qty FROM li GROUP BY s")
def _min_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "lineitem", "l_suppkey AS s", "cast(l_quantity as long) AS qty").min_by_key("s", "qty").rows()


@library("topk_per_key", "SELECT c, o FROM (SELECT c, o, row_number() OVER (PARTITION BY c ORDER BY o DESC) r FROM (SELECT DISTINCT c, o FROM ord)) WHERE r BETWEEN 2 AND 3")
def _topk(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "orders", "o_custkey AS c", "o_orderkey AS o").top_k("c", [F.desc("o")], limit=2, offset=1).rows()


@library("topk_with_index", "SELECT c, o, r AS place FROM (SELECT c, o, row_number() OVER (PARTITION BY c ORDER BY o) - 1 AS r FROM (SELECT DISTINCT c, o FROM ord)) WHERE r < 3")
def _topk_index(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "orders", "o_custkey AS c", "o_orderkey AS o").top_k("c", [F.asc("o")], limit=3, index="place").rows()


@library("orderby_limit_offset", "SELECT o, c FROM ord ORDER BY c DESC, o LIMIT 25 OFFSET 10")
def _orderby(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "orders", "o_orderkey AS o", "o_custkey AS c").order_by([F.desc("c"), F.asc("o")], limit=25, offset=10).df.drop(z.MULT)


@library("orderby_with_index", "SELECT s, k, row_number() OVER (ORDER BY k, s) - 1 AS place FROM sup")
def _orderby_index(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "supplier", "s_suppkey AS s", "cast(s_nationkey as long) AS k").order_by_with_index([F.asc("k"), F.asc("s")], index="place").df.drop(z.MULT)


#: Row r of n in SQL: an even share of the open interval, in as many digits as n + 1 has and one.
_EVENLY = "rtrim(lpad(CAST((CAST(r AS HUGEINT) * CAST(pow(10, length(CAST(n + 1 AS VARCHAR)) + 1) AS HUGEINT)) // (n + 1) AS VARCHAR), CAST(length(CAST(n + 1 AS VARCHAR)) + 1 AS INTEGER), '0'), '0')"


@library("orderby_fractional_index", f"SELECT s, k, {_EVENLY} AS place FROM (SELECT s, k, row_number() OVER (ORDER BY k, s) AS r, count(*) OVER () AS n FROM sup)")
def _orderby_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "supplier", "s_suppkey AS s", "cast(s_nationkey as long) AS k").order_by_with_fractional_index([F.asc("k"), F.asc("s")], index="place").df.drop(z.MULT)


@library("grouped_orderby", f"SELECT k, s, {_EVENLY} AS place FROM (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS r, least(2, count(*) OVER (PARTITION BY k)) AS n FROM sup) WHERE r <= 2")
def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "supplier", "cast(s_nationkey as long) AS k", "s_suppkey AS s").grouped_order_by_with_fractional_index("k", [F.desc("s")], limit=2, index="place").df.drop(z.MULT)


# Streams

_DEGREE = program_text(["Graph"], ["R(a: number, n: number)", "T(a: number, b: number)"], "R(a, count(b)) :- Graph(a, b). T(a, b) :- Graph(a, b). T(a, c) :- T(a, b), Graph(b, c).")


@library("stream_insert_retract", _recursive("g AS (SELECT a, b FROM graph WHERE a % 10 <> 8), t(a, b) AS (SELECT a, b FROM g UNION SELECT t.a, g.b FROM t JOIN g ON g.a = t.b)", "SELECT a, b FROM t"))
def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """The closure of the whole graph, in three epochs: every second edge, the others, then a tenth is taken back."""
    graph = relations(spark, folder)["Graph"]
    session = Session(spark, _DEGREE, {"Graph": graph.where("(c0 + c1) % 2 = 0")})
    session.advance()
    session.update_df("Graph", graph.where("(c0 + c1) % 2 = 1"))
    session.advance()
    session.update_df("Graph", graph.where("c0 % 10 = 8").withColumn(z.MULT, F.lit(-1).cast("long")))
    session.advance()
    return session.relation("T")


@library("stream_window_move", "SELECT s, k FROM (SELECT s, k, row_number() OVER (ORDER BY k, s) - 1 AS r FROM sup) WHERE r BETWEEN 20 AND 34")
def _window(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "supplier", "s_suppkey AS s", "cast(s_nationkey as long) AS k")
    window = MovableWindow(rows.filter("s % 2 = 0"), [], [F.asc("k"), F.asc("s")], limit=5)
    window.update(rows.filter("s % 2 = 1"))
    window.move(offset=20, limit=15)
    return window.rows().drop("index")


@library("window_per_key", "SELECT k, s FROM (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s DESC) AS r FROM sup WHERE s % 5 <> 3) WHERE r BETWEEN 2 AND 3")
def _window_per_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "supplier", "s_suppkey AS s", "cast(s_nationkey as long) AS k")
    window = MovableWindow(rows.filter("s % 3 = 0"), ["k"], [F.desc("s")], limit=2, offset=1)
    window.update(rows.filter("s % 3 != 0"))
    window.update(rows.filter("s % 5 = 3").negate())
    return window.rows().drop("index")


@library("session_replace_program", "SELECT DISTINCT region AS x FROM nat WHERE region <> 4")
def _replace(spark: SparkSession, folder: str) -> DataFrame:
    """Other rules over the facts that a store has, the rows of one region taken back between."""
    store = Store(spark, program_text(["Graph"], ["R(x: number)"], "R(a) :- Graph(a, _)."))
    edges = [(r.c0, r.c2) for r in relations(spark, folder)["Nation"].toLocalIterator()]
    for row in edges:
        store.update("Graph", row)
    store.flush()
    for row in edges:
        if row[1] == 4:
            store.update("Graph", row, -1)
    store.replace_program(program_text(["Graph"], ["Q(x: number)"], "Q(b) :- Graph(_, b)."))
    return store.relation("Q")


# The optimiser's knobs

_STAR = "R(n, count(s)) :- Nation(k, n, 2), Customer(c, k, _), Orders(o, c, _, _), Lineitem(o, _, s, qty, _), qty > 30."
_STAR_SQL = "SELECT nat.name, count(*) AS n FROM nat JOIN cust USING (k) JOIN ord USING (c) JOIN li USING (o) WHERE region = 2 AND qty > 30 GROUP BY nat.name"
datalog("sip_invariance", "Nation Customer Orders Lineitem", "R(name: string, n: number)", _STAR + " .sip", _STAR_SQL)
datalog("plan_order_invariance", "Lineitem Customer Nation Orders", "R(name: string, n: number)", "R(n, count(s)) :- Lineitem(o, _, s, qty, _), Customer(c, k, _), Orders(o, c, _, _), Nation(k, n, 2), qty > 30. .optimize", _STAR_SQL)
datalog("optimise_level_3", "Nation Customer Orders Lineitem", "R(name: string, n: number)", _STAR, _STAR_SQL, level=3)

# Files


@library("csv_roundtrip", "SELECT CAST(id AS BIGINT) AS id, text, w FROM (VALUES (1, 'hello, world', 0.5), (2, 'plain', -3.0), (3, 'with \"quotes\"', 42.0), (4, '', 7.25), (5, 'back\\slash', 1.0)) AS t(id, text, w)".replace("0.5)", "CAST(0.5 AS DOUBLE))").replace("-3.0)", "CAST(-3.0 AS DOUBLE))").replace("42.0)", "CAST(42.0 AS DOUBLE))").replace("7.25)", "CAST(7.25 AS DOUBLE))").replace("1.0)", "CAST(1.0 AS DOUBLE))"))
def _csv(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.ast import Attribute, RelDecl

    path = f"{shared_base(spark)}/csv-roundtrip-{uuid.uuid4().hex}"
    rows = [(1, "hello, world", 0.5), (2, "plain", -3.0), (3, 'with "quotes"', 42.0), (4, "", 7.25), (5, "back\\slash", 1.0)]
    write_csv_folder(spark.createDataFrame(rows, "id long, text string, w double"), path)
    decl = RelDecl("Text", (Attribute("id", "number"), Attribute("text", "string"), Attribute("w", "float")))
    return parse_lines(spark.read.text(path), decl).toDF("id", "text", "w")


@library("facts_declared", "SELECT DISTINCT name, s FROM sup JOIN nat USING (k)")
def _declared(spark: SparkSession, folder: str) -> DataFrame:
    """Fact lines through their declarations, joined by a program; names in quotes, a blank line between."""
    text = ".in\n.decl Place(k: number, name: string) .input places.csv\n.decl Supplier(s: number, k: number)\n.out\n.decl R(name: string, s: number)\n.rule\nR(x, s) :- Supplier(s, k), Place(k, x)."
    program, have = parse_program(text), relations(spark, folder)
    lines = {
        "Place": have["Nation"].select(F.concat(F.col("c0"), F.lit(', "'), F.col("c1"), F.lit('" ')).alias("value")).unionAll(spark.createDataFrame([("",)], "value string")),
        "Supplier": have["Supplier"].select(F.concat_ws(",", "c0", "c1").alias("value")),
    }
    return Engine(spark).run(program, {d.name: parse_lines(lines[d.name], d) for d in program.edbs})["R"]
