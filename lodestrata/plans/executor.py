"""Runs an analysed program: each stratum becomes DataFrames over its inputs; only recursion starts jobs by itself."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import AnalysisError
from ..functions.types import column_type
from .analyzer import Analysis, analyze
from .ast import Atom, Program, Rule
from .fixpoint import RecursiveRule, semi_naive
from .pairs import inner, many, pairs, shapes, within
from .parser import parse_program
from .planner import Options, RulePlan
from .strata import Stratum


#: Estimated bytes from which a relation is dealt once for all rounds of a loop.
DEAL_FROM = 256 << 20


class Engine:
    """Evaluates programs. ``level`` and ``sharing`` are the optimiser's knobs; results never depend on them."""

    def __init__(self, spark: SparkSession, level: int | None = None, sharing: bool = True, max_rounds: int = 1000):
        self.spark, self.options, self.max_rounds = spark, Options(level, sharing), max_rounds
        self._kept: list[DataFrame] = []

    def release(self) -> None:
        """Lets go of what earlier runs kept because several rules read it; results stay valid and are derived anew."""
        for rows in self._kept:
            rows.unpersist()
        self._kept.clear()

    def run(self, program: Program | str, facts: Mapping[str, DataFrame | list]) -> dict[str, DataFrame]:
        """The declared output relations, with their declared column names. Relations without facts are empty."""
        program = parse_program(program) if isinstance(program, str) else program
        analysis = analyze(program)
        env = self.evaluate(analysis, self.inputs(analysis, facts))
        return {d.name: self.named(analysis, d.name, env[d.name]) for d in program.idbs}

    def named(self, analysis: Analysis, name: str, rows: DataFrame) -> DataFrame:
        return rows.toDF(*analysis.columns[name])

    def schema(self, analysis: Analysis, name: str) -> str:
        return ", ".join(f"c{k} {column_type(t).spark.simpleString()}" for k, t in enumerate(analysis.types[name])) or "none int"

    def inputs(self, analysis: Analysis, facts: Mapping[str, DataFrame | list]) -> dict[str, DataFrame]:
        """Facts by position, in the relations' types; lists of tuples are taken too."""
        out = {}
        for name in facts:
            if analysis.program.edb(name) is None:
                raise AnalysisError(f"facts for {name}, which is no input relation")
        for decl in analysis.program.edbs:
            rows = facts.get(decl.name, [])
            types = [column_type(t).spark for t in analysis.types[decl.name]]
            if not isinstance(rows, DataFrame):
                rows = self.spark.createDataFrame([tuple(float(v) if t.simpleString() == "double" else v for v, t in zip(r, types, strict=True)) for r in rows], self.schema(analysis, decl.name))
            if len(rows.columns) != decl.arity:
                raise AnalysisError(f"{decl.name} has {decl.arity} columns, but its facts have {len(rows.columns)}")
            given = rows.schema.fields
            named = rows.toDF(*(f"c{k}" for k in range(decl.arity)))
            out[decl.name] = named.select(*(F.col(f"c{k}") if given[k].dataType == t else F.col(f"c{k}").cast(t).alias(f"c{k}") for k, t in enumerate(types)))
        return out

    def evaluate(self, analysis: Analysis, env: dict[str, DataFrame], only: set[str] | None = None, old: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All relations; with ``only``, strata without a head in it keep their ``old`` rows."""
        env = dict(env)
        derived = {r.head.name for r in analysis.program.rules}
        for decl in analysis.program.idbs:
            if decl.name not in derived and decl.name not in env:
                env[decl.name] = self.spark.createDataFrame([], self.schema(analysis, decl.name))
        readers: dict[str, int] = {}
        for rule in analysis.program.rules:
            for name in {a.name for a in [*rule.atoms, *rule.negations]}:
                readers[name] = readers.get(name, 0) + 1
        for stratum in analysis.strata:
            if only is not None and old is not None and not only & set(stratum.heads):
                env.update({h: old[h] for h in stratum.heads})
            elif stratum.recursive:
                env.update(self._recursive(analysis, stratum, env))
            else:
                head = stratum.heads[0]
                rows = self._head(analysis, head, stratum.rules, env)
                if self.options.sharing and readers.get(head, 0) > 1:
                    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                    self._kept.append(rows)
                env[head] = rows
        return env

    def rule_rows(self, analysis: Analysis, rule: Rule, env: Mapping[str, DataFrame], bag: bool, sources: Mapping[int, DataFrame] | None = None) -> DataFrame:
        read = lambda i, atom: sources[i] if sources and i in sources else env[atom.name]
        sizes = {a.name: estimated_bytes(env[a.name]) for a in rule.atoms if a.name in env} if self.options.planned(rule) else None
        return RulePlan(rule, analysis, self.options, sizes).head(read, lambda atom: env[atom.name], bag, self.spark)

    def _head(self, analysis: Analysis, head: str, rules: tuple[Rule, ...], env: Mapping[str, DataFrame]) -> DataFrame:
        """The union of all rules of a head (and its facts), as a set or aggregated once as a bag."""
        op = analysis.aggregates.get(head)
        if op is None and head not in env and (found := shapes(rules, analysis)) and many(self, analysis, found, env):
            return pairs(self, analysis, found, env)
        parts = [self.rule_rows(analysis, r, env, op is not None) for r in rules]
        if head in env:
            parts.append(env[head])
        union = reduce(DataFrame.unionAll, parts)
        return aggregated(union, op) if op else union.distinct()

    def _recursive(self, analysis: Analysis, stratum: Stratum, env: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        minima = {h: analysis.aggregates[h] for h in stratum.heads if h in analysis.aggregates}
        if len(stratum.heads) == 1 and not minima and stratum.heads[0] not in env and (rows := self._through_inner(analysis, stratum, env)) is not None:
            return {stratum.heads[0]: rows}
        out = self._component(analysis, stratum.heads, stratum.rules, env, minima)
        plain = tuple(h for h in stratum.heads if h not in minima)
        if minima and plain:
            # Sets may have taken values that a later minimum superseded: derive them again from the final minima.
            settled = {**env, **{h: out[h] for h in minima}}
            again = self._component(analysis, plain, tuple(r for r in stratum.rules if r.head.name in plain), settled, {})
            out = {**out, **again}
        return out

    def _through_inner(self, analysis: Analysis, stratum: Stratum, env: Mapping[str, DataFrame]) -> DataFrame | None:
        """A head of pairs: the loop runs over those rows alone that a further row can be derived from; all rows are paired
        once, from these, and not kept."""
        (head,) = stratum.heads
        if (through := inner(stratum.rules, analysis)) is None:
            return None
        loop, columns = through
        exits = tuple(r for r in stratum.rules if r is not loop)
        if not exits or not many(self, analysis, shapes(exits, analysis), env):
            return None
        names = [f"__only{k}" for k, _, _ in columns]
        only = {n: env[relation].select(F.col(f"c{j}").alias("c0")).where("c0 is not null").distinct() for n, (_, relation, j) in zip(names, columns, strict=True)}
        types = {n: (analysis.types[relation][j],) for n, (_, relation, j) in zip(names, columns, strict=True)}
        asked = replace(analysis, types={**analysis.types, **types})
        rules = tuple(within(r, names) for r in stratum.rules)
        kept = self._component(asked, stratum.heads, rules, {**env, **only}, {})[head]
        return pairs(self, analysis, shapes(stratum.rules, analysis), {**env, head: kept})

    def _component(self, analysis: Analysis, heads: tuple[str, ...], rules: tuple[Rule, ...], env: Mapping[str, DataFrame], minima: dict[str, str]) -> dict[str, DataFrame]:
        inside = set(heads)
        exits = [r for r in rules if not any(a.name in inside for a in r.atoms)]
        loops = [r for r in rules if any(a.name in inside for a in r.atoms)]
        static = self.static(loops, inside, env)
        start = {}
        for head in heads:
            parts = [self.rule_rows(analysis, r, env, head in minima) for r in exits if r.head.name == head]
            if head in env:
                parts.append(env[head])
            start[head] = reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], self.schema(analysis, head))

        def recursive(rule: Rule) -> RecursiveRule:
            atoms = [(i, a.name) for i, a in enumerate(rule.atoms) if a.name in inside]
            return RecursiveRule(rule.head.name, atoms, lambda sources: self.rule_rows(analysis, rule, static, rule.head.name in minima, sources))

        try:
            return semi_naive(start, [recursive(r) for r in loops], minima, self.max_rounds)
        finally:
            self.let_go(loops, inside, static)

    def let_go(self, rules: list[Rule], inside: set[str], static: Mapping[str, DataFrame]) -> None:
        """Ends what ``static`` began."""
        for name in {a.name for r in rules for a in [*r.atoms, *r.negations]} - inside:
            static[name].unpersist()

    def static(self, rules: list[Rule], inside: set[str], env: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Relations that the loop reads in every round are kept; large ones dealt by the key of their join where it is one and
        the same everywhere, so that rounds shuffle only what is new. How smaller ones are joined is left to the engine."""
        keys: dict[str, set[tuple[int, ...]]] = {}
        for rule in rules:
            for i, atom in enumerate(rule.atoms):
                if atom.name not in inside:
                    others = {v for j, a in enumerate(rule.atoms) if j != i for v in a.variables}
                    keys.setdefault(atom.name, set()).add(_positions(atom, others))
            for atom in rule.negations:
                keys.setdefault(atom.name, set()).add(_positions(atom, set(atom.variables)))
        out = dict(env)
        for name, used in keys.items():
            rows = env[name]
            if len(used) == 1 and (key := next(iter(used))) and estimated_bytes(rows) >= DEAL_FROM:
                rows = rows.repartition(*(F.col(f"c{k}") for k in key))
            out[name] = rows.persist(StorageLevel.MEMORY_AND_DISK)
        return out


def estimated_bytes(rows: DataFrame) -> int:
    """What the engine's own statistics say of a frame, without running it."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _positions(atom: Atom, variables: set[str]) -> tuple[int, ...]:
    seen: dict[str, int] = {}
    for k, arg in enumerate(atom.args):
        if getattr(arg, "name", None) in variables:
            seen.setdefault(arg.name, k)
    return tuple(seen.values())


def aggregated(rows: DataFrame, op: str) -> DataFrame:
    """Groups by all columns but the last and aggregates that; a global aggregate of no rows gives no row."""
    *keys, value = rows.columns
    result = {"count": F.count(F.lit(1)), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}[op].alias(value)
    if keys:
        return rows.groupBy(*keys).agg(result)
    return rows.agg(result, F.count(F.lit(1)).alias("n")).where("n > 0").select(value)
