"""The line protocol of a change stream.

``+ Rel a,b`` and ``- Rel a,b`` queue changes, a blank line or ``.advance`` applies them, ``.quit`` ends, ``#`` starts a
comment. Results are lines ``+n<TAB>Rel<TAB>a,b``, one for each row that changed on balance; errors are ``!<TAB>message``
and change nothing. Cells follow the rules of fact files, in the types of the relation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from ..errors import DatalogError
from ..functions.types import column_type
from ..operators.zset import MULT
from ..sources.files import csv_cell
from .session import Session


@dataclass(frozen=True)
class Change:
    sign: int
    relation: str
    cells: tuple[str, ...]


def split_cells(text: str, delimiter: str = ",") -> list[str]:
    """The cells of one line: blanks around them go, quoted ones may hold delimiters and doubled quotes."""
    out, at = [], 0
    while True:
        while at < len(text) and text[at] in " \t" and text[at] != delimiter:
            at += 1
        if at < len(text) and text[at] == '"':
            cell, at = "", at + 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    raise DatalogError("unterminated quote")
                cell += text[at:end]
                at = end + 1
                if not text.startswith('"', at):
                    break
                cell, at = cell + '"', at + 1
            rest = text.find(delimiter, at)
            rest = len(text) if rest < 0 else rest
            if text[at:rest].strip():
                raise DatalogError("text beside a quoted value")
        else:
            rest = text.find(delimiter, at)
            rest = len(text) if rest < 0 else rest
            cell = text[at:rest].strip()
        out.append(cell)
        if rest >= len(text):
            return out
        at = rest + 1


def parse_line(line: str, delimiter: str = ",") -> Change | str | None:
    """A change, 'advance', 'quit', or None for a comment."""
    line = line.strip()
    if not line or line == ".advance":
        return "advance"
    if line == ".quit":
        return "quit"
    if line.startswith("#"):
        return None
    sign, _, rest = line.partition(" ")
    relation, _, cells = rest.strip().partition(" ")
    if sign not in ("+", "-") or not relation or not cells.strip():
        raise DatalogError(f"expected '+ Rel a,b', '- Rel a,b', a blank line, .advance or .quit, found {line!r}")
    return Change(1 if sign == "+" else -1, relation, tuple(split_cells(cells, delimiter)))


def typed(session: Session, change: Change) -> tuple:
    session._check(change.relation)
    types = session.analysis.types[change.relation]
    if len(types) != len(change.cells):
        raise DatalogError(f"{change.relation}: expected {len(types)} values, got {len(change.cells)}")
    out = []
    for cell, kind in zip(change.cells, types, strict=True):
        try:
            out.append(column_type(kind).parse(cell))
        except ValueError:
            raise DatalogError(f"{change.relation}: {cell!r} is no {kind}") from None
    return tuple(out)


def run_stream(session: Session, lines: Iterable[str], write: Callable[[str], None], delimiter: str = ",") -> None:
    """Starts with an epoch over the initial facts; the end of input is a last advance."""

    def tick() -> None:
        for name, change in session.advance().items():
            for row in change.orderBy(*change.columns).toLocalIterator():
                *values, n = tuple(row)
                write(f"{n:+d}\t{name}\t{','.join(csv_cell(v) for v in values)}")

    tick()
    queued = False
    for line in lines:
        try:
            got = parse_line(line, delimiter)
            if isinstance(got, Change):
                session.update(got.relation, typed(session, got), got.sign)
                queued = True
        except DatalogError as error:
            write(f"!\t{error}")
            continue
        if got == "advance" and queued:
            tick()
            queued = False
        if got == "quit":
            break
    if queued:
        tick()
    session.close()


__all__ = ["MULT", "Change", "parse_line", "run_stream", "split_cells"]
