"""Heads that pair rows of two sides: H(x.., y) :- Left(x.., k..), Right(y, k..), where the key is no part of the head. There may
be as many pairs as the square of a key's rows, so the pairs themselves are neither shuffled nor held as a set:

* A pair has one derivation where x or y has one key alone. Only pairs of an x and a y that both have several need a
  distinct, and they are joined apart.
* The right side is packed into arrays of about ``CHUNK`` values of a key; left rows meet those, dealt by key and chunk, so
  one key's pairs spread over tasks and a task holds one array at a time.
* A negation that spans both sides is looked up among such pairs alone as share a key, and taken from the arrays.

Several rules of a head go together where they have the same right side: a left row carries which of them it is of.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .analyzer import Analysis
from .ast import Arith, Atom, Comparison, Negation, Rule, Var
from .planner import RulePlan, core_atoms

#: Values of a right side in one array, about.
CHUNK = 1024
#: Rows of a key on the right side, on average, from which a head is paired so, and estimated bytes below which nothing is counted.
MANY, SMALL = 8, 64 << 10
LEFT, RIGHT = "__left", "__right"


@dataclass(frozen=True)
class Shape:
    """A rule's two sides: what they bind, and what only both together can decide."""

    rule: Rule
    left: Rule
    right: Rule
    xs: tuple[str, ...]
    y: str
    keys: tuple[str, ...]
    comparisons: tuple[Comparison, ...]
    negations: tuple[Atom, ...]


def shape(rule: Rule, analysis: Analysis) -> Shape | None:
    head = [a.first for a in rule.head.args if isinstance(a, Arith) and not a.rest and isinstance(a.first, Var)]
    names = [v.name for v in head]
    if len(head) != len(rule.head.args) or len(set(names)) != len(names) or len(names) < 2 or rule.plan or rule.sip:
        return None
    kinds = {t for a in [*rule.atoms, *rule.negations] for t in analysis.types[a.name]}
    if not kinds <= {"number", "string"}:  # floats have two zeros, which arrays tell apart
        return None
    core = core_atoms(rule)
    for last in reversed(core) if len(core) > 1 else ():
        own = set(last.variables)
        others = [a for a in core if a is not last]
        bound = {v for a in others for v in a.variables}
        new, keys = own - bound, tuple(v for v in dict.fromkeys(last.variables) if v in bound)
        ys = [n for n in names if n in new]
        if len(ys) != 1 or not keys or set(keys) & set(names) or not set(names) - {ys[0]} <= bound:
            continue
        both = set(names)
        sides: tuple[list, list] = ([], [])
        cross: list = []
        for p in rule.body:
            if p is last:
                sides[1].append(p)
                continue
            used = set((p.atom if isinstance(p, Negation) else p).variables) if not hasattr(p, "value") else set()
            fits = [used <= bound, used <= own]
            if isinstance(p, Atom) and p in others:
                fits = [True, False]
            for side, here in zip(sides, fits, strict=True):
                if here and (used or side is sides[0]):
                    side.append(p)
            if not any(fits):
                cross.append(p)
        if any(isinstance(p, Atom) for p in cross) or not all(set((p.atom if isinstance(p, Negation) else p).variables) <= both for p in cross):
            continue
        xs = tuple(n for n in names if n != ys[0])
        make = lambda name, variables, body: replace(rule, head=replace(rule.head, name=name, args=tuple(Arith(Var(v)) for v in variables)), body=tuple(body))
        found = Shape(rule, make(LEFT, (*xs, *keys), sides[0]), make(RIGHT, (ys[0], *keys), sides[1]), xs, ys[0], keys, tuple(p for p in cross if isinstance(p, Comparison)), tuple(p.atom for p in cross if isinstance(p, Negation)))
        return found
    return None


def _outline(s: Shape) -> tuple:
    """The right side without its variables' names."""
    place = {v: k for k, v in enumerate((s.y, *s.keys))}
    atom = s.right.body[0]
    return atom.name, tuple((place.get(a.name, "_") if isinstance(a, Var) else str(a)) for a in atom.args), [a.first.name for a in s.rule.head.args].index(s.y)


def shapes(rules: tuple[Rule, ...], analysis: Analysis) -> list[Shape] | None:
    """Of all rules of a head, if they go together."""
    out = [shape(r, analysis) for r in rules]
    if not out or None in out:
        return None
    if len(out) > 1 and (any(len(s.right.body) > 1 or s.negations for s in out) or len({_outline(s) for s in out}) > 1):
        return None
    return out


def _side(engine, analysis: Analysis, s: Shape, rule: Rule, names: list[str], env: Mapping[str, DataFrame]) -> DataFrame:
    own = RulePlan(s.rule, analysis, engine.options).types
    typed = replace(analysis, types={**analysis.types, rule.head.name: tuple(own[a.first.name] for a in rule.head.args)})
    rows = engine.rule_rows(typed, rule, env, False).toDF(*names)
    return reduce(DataFrame.where, [F.col(k).isNotNull() for k in names if k.startswith("k")], rows)


def many(engine, analysis: Analysis, found: list[Shape], env: Mapping[str, DataFrame]) -> bool:
    """Whether a key has many rows on the right side; this is counted, but decides about the plan alone."""
    s = found[0]
    keys = [f"k{k}" for k in range(len(s.keys))]
    right = _side(engine, analysis, s, s.right, ["y", *keys], env)
    if int(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL:
        return False
    rows, distinct = right.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
    return rows >= MANY * max(1, distinct)


def pairs(engine, analysis: Analysis, found: list[Shape], env: Mapping[str, DataFrame]) -> DataFrame:
    """The head's rows, once each."""
    first = found[0]
    xs, keys = [f"x{k}" for k in range(len(first.xs))], [f"k{k}" for k in range(len(first.keys))]
    order = [a.first.name for a in first.rule.head.args]
    lefts = [_side(engine, analysis, s, s.left, [*xs, *keys], env).withColumn("of", F.lit(1 << i).cast("long")) for i, s in enumerate(found)]
    left = reduce(DataFrame.unionAll, lefts).groupBy(*xs, *keys).agg(F.bit_or("of").alias("of"))
    right = _side(engine, analysis, first, first.right, ["y", *keys], env).distinct()
    n = F.count(F.lit(1))
    left = left.withColumn("x_lone", n.over(Window.partitionBy(*xs)) == 1)
    right = right.withColumn("y_lone", n.over(Window.partitionBy("y")) == 1)

    packing = [*keys, "y_lone"]
    sizes = right.groupBy(*packing).agg(F.ceil(n / CHUNK).cast("long").alias("chunks"))
    placed = right.join(sizes, packing).withColumn("chunk", F.pmod(F.xxhash64("y"), "chunks")).drop("chunks")
    packs = placed.groupBy(*packing, "chunk").agg(F.collect_list("y").alias("ys"), F.max(F.col("y").isNull()).alias("nulls"))
    packs = packs.withColumn("ys", F.when(F.col("nulls"), F.array_append("ys", F.lit(None))).otherwise(F.col("ys"))).drop("nulls")
    meets = left.join(sizes, keys).where("x_lone or y_lone").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    column = {**dict(zip(first.xs, xs, strict=True)), first.y: "y"}
    denied = [_denied(atom, first, analysis, engine, env, column) for atom in first.negations]
    ys: Column = F.col("ys")
    if denied:
        gone = []
        for rows, on in denied:
            here = rows.join(left, on) if on else rows.crossJoin(left)
            gone.append(here.join(placed, ["y", *keys]).where("x_lone or y_lone").select(*xs, *packing, "chunk", "y"))
        taken = reduce(DataFrame.unionAll, gone).groupBy(*xs, *packing, "chunk").agg(F.collect_set("y").alias("gone"))
        at = [*xs, *packing, "chunk"]
        same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at])
        meets = meets.alias("l").join(taken.alias("r"), same, "left").select("l.*", "r.gone")
        ys = F.when(F.col("gone").isNull(), ys).otherwise(F.array_except("ys", "gone"))
    tasks = int(engine.spark.conf.get("spark.sql.shuffle.partitions"))
    quick = meets.repartition(tasks, *packing, "chunk").join(packs, [*packing, "chunk"]).select(*xs, "of", F.explode(ys).alias("y"))

    slow = left.where("not x_lone").join(right.where("not y_lone"), keys).select(*xs, "of", "y")
    for rows, on in denied:
        slow = slow.join(rows, [*on, "y"], "left_anti")
    holds = [_holds(s, analysis, engine, dict(zip(s.xs, xs, strict=True)) | {s.y: "y"}, 1 << i) for i, s in enumerate(found)]
    if any(s.comparisons for s in found):
        quick, slow = (rows.where(reduce(lambda a, b: a | b, holds)) for rows in (quick, slow))
    head = [F.col(column[v]).alias(f"c{k}") for k, v in enumerate(order)]
    return quick.select(*head).unionAll(slow.select(*head).distinct())


def _holds(s: Shape, analysis: Analysis, engine, column: dict[str, str], bit: int) -> Column:
    plan = RulePlan(s.rule, analysis, engine.options)
    plan.columns = column
    return reduce(lambda a, b: a & b, [plan._compare(c) for c in s.comparisons], F.col("of").bitwiseAND(F.lit(bit).cast("long")) != 0)


def _denied(atom: Atom, s: Shape, analysis: Analysis, engine, env: Mapping[str, DataFrame], column: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """A negated atom's rows by the sides' columns, and those of the left side."""
    plan = RulePlan(s.rule, analysis, engine.options)
    plan.columns = {**plan.columns, **column}
    rows = plan.atom_frame(atom, env[atom.name])
    return rows.distinct(), [c for c in rows.columns if c != "y"]


def inner(rules: tuple[Rule, ...], analysis: Analysis) -> tuple[Rule, list[tuple[int, str, int]]] | None:
    """For a head whose only recursive rule pairs rows through one row of it: that rule, and for each of the head's columns a
    relation and a column of it that hold all values with which such a row is joined."""
    head = rules[0].head.name
    loops = [r for r in rules if any(a.name == head for a in r.atoms)]
    if len(loops) != 1 or shapes(rules, analysis) is None:
        return None
    (loop,) = loops
    mine = [a for a in loop.atoms if a.name == head]
    if len(mine) != 1 or any(n.name == head for r in rules for n in r.negations):
        return None
    out = []
    for k, arg in enumerate(mine[0].args):
        at = [(a.name, j) for a in loop.atoms if a is not mine[0] for j, b in enumerate(a.args) if isinstance(b, Var) and isinstance(arg, Var) and b.name == arg.name]
        if not at or arg.name in {v for a in loop.head.args for v in a.variables}:
            return None
        out.append((k, *at[0]))
    return loop, out


def within(rule: Rule, given: list[str]) -> Rule:
    """The rule for such head rows alone as the given relations of one column each hold."""
    return replace(rule, body=(*(Atom(name, (arg.first,)) for name, arg in zip(given, rule.head.args, strict=True)), *rule.body))
