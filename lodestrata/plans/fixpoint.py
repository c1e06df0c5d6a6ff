"""Fixpoints as driver loops over DataFrames: one Spark job a round, work in proportion to what is new.

``semi_naive`` evaluates the rules of a recursive component. Each recursive rule gives one term for each of its
recursive atoms: that atom reads the last round's new rows, those before it everything so far, those behind it
everything before the new rows. So non-linear and mutual recursion lose nothing and derive nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..errors import FixpointError
from .durable import counted, durable

#: A term of a recursive rule: rows for the head, given the sources of its recursive atoms by their position.
Term = Callable[[dict[int, DataFrame]], DataFrame]
#: Rounds after which the parts of a total are written as one.
MERGE_EVERY = 6
#: Rows of a total from which its parts are kept dealt and sorted; below, comparing with all of it at once is quicker.
KEEP_FROM = 2_000_000


@dataclass
class RecursiveRule:
    head: str
    #: Position in the body and name of each atom that reads the component.
    atoms: list[tuple[int, str]]
    term: Term


class Total:
    """All rows of a head so far, as a few checkpointed parts. The parts of a large total are dealt and sorted by the
    columns that new rows are compared on, and kept so: a round neither shuffles nor sorts what earlier rounds found. A
    head with a minimum (or maximum) keeps its improvements as they came; a group's value is the best of them. Known rows
    are read by every round too, so they are kept, and large ones kept dealt in the same way."""

    def __init__(self, arity: int, op: str | None, parts: list[DataFrame], rows: int, known: DataFrame | None = None):
        self.arity, self.op, self.known, self.dealt = arity, op, known, False
        self.columns = [f"c{k}" for k in range(arity)]
        self.keys, self.value = (self.columns[:-1], self.columns[-1]) if op else (self.columns, None)
        self.parts, self.rows = list(parts), rows
        self.kept: list[DataFrame] | None = None
        if known is not None:
            self.known = known.persist(StorageLevel.MEMORY_AND_DISK)
            if self.known.count() >= KEEP_FROM:
                self.known, self.dealt = self._keep(self.known), True
        self._plain = known
        self._keep_large()

    def _keep_large(self) -> None:
        if self.kept is None and self.rows >= KEEP_FROM:
            self.kept = [self._keep(p) for p in self.parts]

    def _keep(self, rows: DataFrame) -> DataFrame:
        if not self.keys:
            return rows
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, *self.keys).sortWithinPartitions(*self.keys).persist(StorageLevel.MEMORY_AND_DISK)

    def found(self) -> DataFrame:
        """What came beside the known rows."""
        rows = _union(self.parts)
        return _best(rows, self.arity, self.op) if self.op and len(self.parts) > 1 else rows

    def frame(self) -> DataFrame:
        return self.found() if self.known is None else self.known.unionAll(self.found())

    def fresh(self, rows: DataFrame) -> DataFrame:
        """What the rows add: those not here yet, or those that better their group."""
        out = _best(rows, self.arity, self.op) if self.op else rows.distinct()
        if self.kept is not None:
            parts = [*([self.known] if self.known is not None else []), *self.kept]
        else:
            parts = [self.known, self.found()] if self.dealt else [self.frame()]
        for part in parts:
            if not self.op:
                out = out.join(part, self.keys, "left_anti")
                continue
            had = part.select(*(F.col(k).alias(f"had_{k}") for k in self.columns))
            better = (F.col(self.value) < F.col(f"had_{self.value}")) if self.op == "min" else (F.col(self.value) > F.col(f"had_{self.value}"))
            same = [F.col(k) == F.col(f"had_{k}") for k in self.keys]
            out = out.join(had, reduce(lambda x, y: x & y, [*same, ~better]), "left_anti")
        return out

    def add(self, rows: DataFrame, n: int) -> None:
        self.parts.append(rows)
        self.rows += n
        if self.kept is not None:
            self.kept.append(self._keep(rows))
        if len(self.parts) > MERGE_EVERY:
            merged = durable(self.found())
            self.release()
            self.parts, self.kept = [merged], None
        self._keep_large()

    def release(self) -> None:
        for part in self.kept or []:
            part.unpersist()

    def close(self) -> None:
        self.release()
        if self._plain is not None:
            self.known.unpersist()
            self._plain.unpersist()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _terms(rules: list[RecursiveRule], head: str, new: dict[str, DataFrame], now: dict[str, DataFrame], before: dict[str, DataFrame | None]) -> list[DataFrame]:
    out = []
    for rule in (r for r in rules if r.head == head):
        for k, (_, name) in enumerate(rule.atoms):
            if name not in new:
                continue
            sources: dict[int, DataFrame] = {}
            for j, (at, other) in enumerate(rule.atoms):
                if j == k:
                    sources[at] = new[name]
                elif j < k:
                    sources[at] = now[other]
                elif before[other] is None:
                    break
                else:
                    sources[at] = before[other]
            else:
                out.append(rule.term(sources))
    return out


def semi_naive(start: dict[str, DataFrame], rules: list[RecursiveRule], minima: dict[str, str], max_rounds: int, known: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The component's heads. ``start``: rows of the rules that read no head of it; ``minima``: 'min' or 'max' by head.
    ``known`` (sets alone): rows that an earlier run closed under the rules; ``start`` then holds new rows alone, and so does
    the result."""
    total: dict[str, Total] = {}
    new: dict[str, DataFrame] = {}
    for head, rows in start.items():
        op, arity = minima.get(head), len(rows.columns)
        first, n = counted(_best(rows, arity, op) if op else rows.distinct())
        total[head] = Total(arity, op, [first], n, known[head] if known else None)
        if n:
            new[head] = first
    before: dict[str, DataFrame | None] = dict(known) if known else dict.fromkeys(start)
    try:
        for _ in range(max_rounds):
            if not new:
                return {h: t.found() for h, t in total.items()}
            now = {h: t.frame() for h, t in total.items()}
            fresh: dict[str, tuple[DataFrame, int]] = {}
            for head in start:
                if terms := _terms(rules, head, new, now, before):
                    found, n = counted(total[head].fresh(_union(terms)))
                    if n:
                        fresh[head] = found, n
            before = now
            for head, (found, n) in fresh.items():
                total[head].add(found, n)
            new = {head: found for head, (found, _) in fresh.items()}
    finally:
        for t in total.values():
            t.close()
    raise FixpointError(f"no fixpoint of {', '.join(sorted(start))} within {max_rounds} rounds")


def _best(rows: DataFrame, arity: int, op: str) -> DataFrame:
    keys, value = [f"c{k}" for k in range(arity - 1)], f"c{arity - 1}"
    grouped = rows.groupBy(*keys).agg((F.min if op == "min" else F.max)(value).alias(value))
    return grouped if keys else grouped.where(F.col(value).isNotNull())


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """All rows reachable from ``seed``: ``step`` gets the rows of the last round that were new. Sets of rows."""
    names = seed.columns
    rows = seed.toDF(*(f"c{k}" for k in range(len(names))))
    rule = RecursiveRule("rows", [(0, "rows")], lambda s: step(s[0].toDF(*names)).toDF(*(f"c{k}" for k in range(len(names)))))
    return semi_naive({"rows": rows}, [rule], {}, max_rounds)["rows"].toDF(*names)
