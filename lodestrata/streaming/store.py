"""Live relations: a session with snapshots, subscriptions, and rules that can be replaced while facts stay."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.zset import MULT, ZSet
from ..plans.ast import Program
from ..plans.durable import durable
from ..plans.parser import parse_program
from .session import Session

Listener = Callable[[], None]


class Collection:
    """A typed handle of one input relation."""

    def __init__(self, store: Store, name: str):
        self.store, self.name = store, name

    def insert(self, *row) -> None:
        self.store.update(self.name, row, 1)

    def delete(self, *row) -> None:
        self.store.update(self.name, row, -1)

    def snapshot(self) -> list[tuple]:
        return self.store.snapshot(self.name)


class Store:
    """Changes are queued and applied by ``flush`` (or by the next read), once for all of them. A new program gets the rows
    that fit it; rows that don't, and relations that a program drops, are parked as checkpointed frames and come back with
    one that has them again."""

    def __init__(self, spark: SparkSession, program: Program | str):
        self.spark = spark
        self._parked: dict[str, list[DataFrame]] = {}
        self._listeners: dict[str, list[Listener]] = {}
        self._program_listeners: list[Listener] = []
        self._open(parse_program(program) if isinstance(program, str) else program)

    def _open(self, program: Program) -> None:
        self.program = program
        self.session = Session(self.spark, program)
        self._dirty = True
        self._echo: set[str] = set()

    def collection(self, name: str) -> Collection:
        self.session._check(name)
        return Collection(self, name)

    def update(self, relation: str, row: tuple, diff: int = 1) -> None:
        self.session.update(relation, row, diff)  # refuses what doesn't fit
        self._echo.add(relation)
        self._dirty = True

    def update_df(self, relation: str, change: DataFrame) -> None:
        """Queues a DataFrame of rows; a column ``__mult`` gives their signs."""
        self.session.update_df(relation, change)
        self._echo.add(relation)
        self._dirty = True

    def flush(self) -> dict[str, DataFrame]:
        """Applies what is queued and tells each changed relation's listeners once."""
        if not self._dirty:
            return {}
        self._dirty = False
        changes, echo = self.session.advance(), self._echo
        self._echo = set()
        for name in {*changes, *echo}:
            for listener in list(self._listeners.get(name, [])):
                listener()
        return changes

    def relation(self, name: str) -> DataFrame:
        """The relation as a DataFrame, after all that was queued; inputs as sets."""
        self.flush()
        rows = self.session.relation(name)
        return rows.distinct() if self.program.idb(name) is None else rows

    def snapshot(self, name: str) -> list[tuple]:
        """The relation's rows in order, for relations that fit the driver; use ``relation`` for others."""
        rows = self.relation(name)
        return [tuple(r) for r in rows.orderBy(*rows.columns).toLocalIterator()]

    def subscribe(self, name: str, listener: Listener) -> Callable[[], None]:
        """Calls back after each flush that changed the relation; returns how to stop that."""
        self._listeners.setdefault(name, []).append(listener)
        return lambda: self._listeners[name].remove(listener) if listener in self._listeners[name] else None

    def subscribe_program(self, listener: Listener) -> Callable[[], None]:
        self._program_listeners.append(listener)
        return lambda: self._program_listeners.remove(listener) if listener in self._program_listeners else None

    live_query = subscribe

    def replace_program(self, program: Program | str) -> None:
        """Other rules over the same facts."""
        self.flush()
        before = {d.name for d in [*self.program.edbs, *self.program.idbs]}
        for decl in self.program.edbs:
            self._parked.setdefault(decl.name, []).append(durable(self.session.facts(decl.name)))
        self.session.close()
        self._open(parse_program(program) if isinstance(program, str) else program)
        for decl in self.program.edbs:
            for rows in self._parked.pop(decl.name, []):
                self._restore(decl.name, rows)
        self.session.advance()
        self._dirty = False
        for name in before | {d.name for d in [*self.program.edbs, *self.program.idbs]}:
            for listener in list(self._listeners.get(name, [])):
                listener()
        for listener in list(self._program_listeners):
            listener()

    def _restore(self, name: str, rows: DataFrame) -> None:
        """Gives the session the rows that fit the relation's columns; the others stay parked."""
        types = self.session.analysis.types[name]
        given = [f.dataType for f in rows.schema.fields if f.name != MULT]
        texts = [t.simpleString() == "string" for t in given]
        if len(given) != len(types) or texts != [t == "string" for t in types]:
            self._parked.setdefault(name, []).append(rows)
            return
        whole = [F.col(f"c{k}") == F.floor(f"c{k}") for k, (t, kind) in enumerate(zip(given, types, strict=True)) if t.simpleString() == "double" and kind == "number"]
        fits = reduce(lambda x, y: x & y, whole, F.lit(True))
        if whole and not (others := durable(rows.where(~fits))).isEmpty():
            self._parked.setdefault(name, []).append(others)
        self.session.update_df(name, rows.where(fits))

    def changes_since(self, name: str, earlier: DataFrame) -> DataFrame:
        """The signed rows between an earlier DataFrame of the relation and now."""
        return ZSet(earlier).diff(ZSet(self.relation(name))).df.orderBy(F.desc(MULT))
