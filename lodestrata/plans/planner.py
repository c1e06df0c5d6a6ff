"""A rule as a DataFrame. Catalyst's logical plan is the only intermediate form: what is decided here is the order of
joins, where a join may be a semi-join, and reducers that Catalyst wouldn't add.

Relations have positional columns c0, c1, ...; variables become columns v<k>_<name>, so that names which differ only in
case don't clash. Bodies are bags (``bag=True``) when the head aggregates; otherwise a set of head rows is wanted and
atoms that add no variables are semi-joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arithmetic import apply_operator, compare
from ..functions.types import column_type, literal, type_of_value, unify
from .analyzer import Analysis, _variable_types, arith_type
from .ast import Aggregate, Arith, Atom, Comparison, Const, Rule, Truth, Var

#: Gives the DataFrame that the i-th positive atom reads (a fixpoint passes deltas); negations are read by name.
Source = Callable[[int, Atom], DataFrame]


#: Sizes of relations that are within this factor count as equal in a join order.
SIZE_STEP = 4


@dataclass(frozen=True)
class Options:
    """``level``: 0 text order, 1 reducers (sideways information passing), 2 planned joins, 3 both; None: the rules' hints."""

    level: int | None = None
    sharing: bool = True

    def planned(self, rule: Rule) -> bool:
        return len(core_atoms(rule)) > 2 and (rule.plan or self.level in (2, 3))

    def reduced(self, rule: Rule) -> bool:
        return len(core_atoms(rule)) > 2 and (rule.sip or self.level in (1, 3))


def core_atoms(rule: Rule) -> list[Atom]:
    """Atoms whose variables aren't all among another atom's (of equal ones the first is core)."""
    sets = [set(a.variables) for a in rule.atoms]
    return [a for i, a in enumerate(rule.atoms) if not any(s < o or (s == o and j < i) for j, o in enumerate(sets) for s in [sets[i]] if i != j)]


def join_order(rule: Rule, planned: bool, sizes: Mapping[str, int] | None = None) -> list[int]:
    """Positions of atoms. In text order, but an atom that shares nothing waits while another connects; planned: always
    the atom that shares most variables next, then the one with most constants, then the smallest relation, beginning with
    the smallest that has most constants. Sizes decide where they differ by SIZE_STEP or more; equal ones keep text order."""
    steps = {n: int(math.log(max(1, b), SIZE_STEP)) for n, b in (sizes or {}).items()}
    size = lambda i: steps.get(rule.atoms[i].name, 0)
    left = list(range(len(rule.atoms)))
    bound: set[str] = set()
    out: list[int] = []
    constants = [sum(isinstance(x, Const) for x in a.args) for a in rule.atoms]
    if planned and left:
        left.sort(key=lambda i: (-constants[i], size(i), i))
    while left:
        shared = {i: len(bound & set(rule.atoms[i].variables)) for i in left}
        fits = [i for i in left if shared[i]] or left
        best = max(fits, key=lambda i: (shared[i], constants[i], -size(i), -i)) if planned and bound else fits[0]
        left.remove(best)
        out.append(best)
        bound |= set(rule.atoms[best].variables)
    return out


class RulePlan:
    """Plans one rule over the sources it is given."""

    def __init__(self, rule: Rule, analysis: Analysis, options: Options, sizes: Mapping[str, int] | None = None):
        self.rule, self.options = rule, options
        self.types = _variable_types(rule, {n: list(t) for n, t in analysis.types.items()})
        self.relation_types = analysis.types
        self.columns = {v: f"v{k}_{v}" for k, v in enumerate(self.types)}
        self.counts = analysis.aggregates.get(rule.head.name) == "count"
        self.order = join_order(rule, options.planned(rule), sizes)

    def value(self, f: Var | Const) -> Column:
        return F.col(self.columns[f.name]) if isinstance(f, Var) else literal(f.value)

    def expression(self, arith: Arith) -> tuple[Column, str]:
        kind = lambda f: self.types[f.name] if isinstance(f, Var) else type_of_value(f.value)
        out, held = self.value(arith.first), kind(arith.first)
        for op, f in arith.rest:
            both = unify(held, kind(f))
            out, held = apply_operator(op, out, self.value(f), both == "number"), both
        return out, held

    def atom_frame(self, atom: Atom, source: DataFrame) -> DataFrame:
        """The atom's variables as columns, once each, after its constants and repeats have filtered."""
        names: dict[str, Column] = {}
        for k, arg in enumerate(atom.args):
            column = F.col(f"c{k}")
            if isinstance(arg, Const):
                source = source.where(column == literal(arg.value))
            elif isinstance(arg, Var):
                if arg.name in names:
                    source = source.where(names[arg.name] == column)
                else:
                    names[arg.name] = column
        own = dict(zip((a.name for a in atom.args if isinstance(a, Var)), (self.relation_types[atom.name][k] for k, a in enumerate(atom.args) if isinstance(a, Var)), strict=True))
        typed = {v: c if own[v] == self.types[v] else c.cast(column_type(self.types[v]).spark) for v, c in names.items()}
        return source.select(*(c.alias(self.columns[v]) for v, c in typed.items()))

    def _compare(self, c: Comparison) -> Column:
        return compare(c.op, self.expression(c.left)[0], self.expression(c.right)[0])

    def _reduce(self, frames: dict[int, DataFrame]) -> dict[int, DataFrame]:
        """Forward and backward semi-joins over the join order; they keep multiplicities."""
        for order in (self.order, self.order[::-1]):
            for step, i in enumerate(order):
                for j in order[:step]:
                    shared = [self.columns[v] for v in self.rule.atoms[i].variables if v in self.rule.atoms[j].variables]
                    if shared:
                        frames[i] = frames[i].join(frames[j].select(*shared), shared, "left_semi")
        return frames

    def body(self, source: Source, negated: Callable[[Atom], DataFrame], bag: bool, spark) -> DataFrame:
        rule = self.rule
        frames = {i: self.atom_frame(a, source(i, a)) for i, a in enumerate(rule.atoms)}
        if self.options.reduced(rule):
            frames = self._reduce(frames)
        waiting = list(rule.comparisons)
        left = [a for a in rule.negations]
        uses = {v for a in rule.head.args for v in a.variables}
        out: DataFrame | None = None
        bound: set[str] = set()
        guards: list[DataFrame] = []
        for step, i in enumerate(self.order):
            variables = set(rule.atoms[i].variables)
            if not variables:
                guards.append(frames[i])
                continue
            shared = [self.columns[v] for v in rule.atoms[i].variables if v in bound]
            if out is None:
                out = frames[i]
            elif variables <= bound and not bag:
                out = out.join(frames[i], shared, "left_semi")
            elif shared:
                out = out.join(frames[i], shared)
            else:
                out = out.crossJoin(frames[i])
            bound |= variables
            for c in [c for c in waiting if set(c.variables) <= bound]:
                waiting.remove(c)
                out = out.where(self._compare(c))
            for atom in [a for a in left if a.variables and set(a.variables) <= bound]:
                left.remove(atom)
                out = out.join(self.atom_frame(atom, negated(atom)), [self.columns[v] for v in atom.variables], "left_anti")
            later = uses | {v for j in self.order[step + 1 :] for v in rule.atoms[j].variables} | {v for c in waiting for v in c.variables} | {v for a in left for v in a.variables}
            if not bag and (gone := bound - later) and later & bound:
                out = out.drop(*(self.columns[v] for v in gone))
                bound -= gone
        if out is None:  # nothing binds a variable: one row, if the guards let it
            out = spark.range(1).select()
        for c in waiting:
            out = out.where(self._compare(c))
        for guard in guards:
            out = out.join(guard.limit(1), F.lit(True), "left_semi")
        for atom in left:
            out = out.join(self.atom_frame(atom, negated(atom)).limit(1), F.lit(True), "left_anti")
        for p in rule.body:
            if isinstance(p, Truth):
                out = out.where(F.lit(p.value))
        return out

    def head(self, source: Source, negated: Callable[[Atom], DataFrame], bag: bool, spark) -> DataFrame:
        """The rule's rows in its head's types; an aggregate's column holds the value to aggregate."""
        kinds, columns = self.relation_types[self.rule.head.name], []
        for k, arg in enumerate(self.rule.head.args):
            arith = arg.arith if isinstance(arg, Aggregate) else arg
            column, kind = self.expression(arith)
            counted = self.counts and k == len(kinds) - 1  # rows count, whatever they hold
            columns.append((F.lit(1).cast("long") if counted else column if kind == kinds[k] else column.cast(column_type(kinds[k]).spark)).alias(f"c{k}"))
        return self.body(source, negated, bag, spark).select(*columns)


def describe(rule: Rule, analysis: Analysis, options: Options) -> list[str]:
    """The steps of a rule's plan, for inspection."""
    plan = RulePlan(rule, analysis, options)
    out, bound, bag = [], set(), rule.head.name in analysis.aggregates
    if options.reduced(rule):
        out.append("reduce atoms by semi-joins, forward and backward")
    for i in plan.order:
        atom, variables = rule.atoms[i], set(rule.atoms[i].variables)
        shared = sorted(variables & bound)
        if not variables:
            out.append(f"guard {atom}")
        elif not bound:
            out.append(f"scan {atom}")
        elif variables <= bound and not bag:
            out.append(f"semi-join {atom} on {', '.join(shared)}")
        else:
            out.append(f"join {atom} on {', '.join(shared)}" if shared else f"cross join {atom}")
        bound |= variables
    out += [f"filter {c}" for c in rule.comparisons] + [f"anti-join {a}" for a in rule.negations]
    return [*out, f"project {rule.head}"]


__all__ = ["Options", "RulePlan", "arith_type", "core_atoms", "describe", "join_order"]
