"""Program syntax as immutable values; they may be built by hand as well as parsed. ``str()`` gives program text."""

from __future__ import annotations

from dataclasses import dataclass

COMPARISONS = ("=", "!=", ">=", ">", "<=", "<")
ARITHMETIC = ("+", "-", "*", "/", "%")
AGGREGATES = ("count", "sum", "min", "max")


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str

    def __str__(self) -> str:
        return f"{self.name}: {self.type}"


@dataclass(frozen=True)
class RelDecl:
    name: str
    attributes: tuple[Attribute, ...] = ()
    path: str | None = None

    @property
    def arity(self) -> int:
        return len(self.attributes)

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.attributes))})"


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: int | float | str

    def __str__(self) -> str:
        return f'"{self.value}"' if isinstance(self.value, str) else format(self.value, "f") if isinstance(self.value, float) and "e" in repr(self.value) else repr(self.value)


@dataclass(frozen=True)
class Placeholder:
    def __str__(self) -> str:
        return "_"


Term = Var | Const | Placeholder


@dataclass(frozen=True)
class Arith:
    """Folds strictly from left to right: no operator binds tighter than another."""

    first: Var | Const
    rest: tuple[tuple[str, Var | Const], ...] = ()

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(f.name for f in (self.first, *(f for _, f in self.rest)) if isinstance(f, Var)))

    def __str__(self) -> str:
        return str(self.first) + "".join(f" {op} {f}" for op, f in self.rest)


@dataclass(frozen=True)
class Aggregate:
    op: str
    arith: Arith

    @property
    def variables(self) -> list[str]:
        return self.arith.variables

    def __str__(self) -> str:
        return f"{self.op}({self.arith})"


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[Term, ...]

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if isinstance(a, Var)))

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Negation:
    atom: Atom

    def __str__(self) -> str:
        return f"!{self.atom}"


@dataclass(frozen=True)
class Comparison:
    left: Arith
    op: str
    right: Arith

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys([*self.left.variables, *self.right.variables]))

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Truth:
    value: bool

    def __str__(self) -> str:
        return str(self.value)


Predicate = Atom | Negation | Comparison | Truth


@dataclass(frozen=True)
class Head:
    name: str
    args: tuple[Arith | Aggregate, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Rule:
    head: Head
    body: tuple[Predicate, ...]
    plan: bool = False
    sip: bool = False

    @property
    def atoms(self) -> list[Atom]:
        return [p for p in self.body if isinstance(p, Atom)]

    @property
    def negations(self) -> list[Atom]:
        return [p.atom for p in self.body if isinstance(p, Negation)]

    @property
    def comparisons(self) -> list[Comparison]:
        return [p for p in self.body if isinstance(p, Comparison)]

    @property
    def aggregate(self) -> Aggregate | None:
        return next((a for a in self.head.args if isinstance(a, Aggregate)), None)

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Program:
    edbs: tuple[RelDecl, ...]
    idbs: tuple[RelDecl, ...]
    rules: tuple[Rule, ...]

    def edb(self, name: str) -> RelDecl | None:
        return next((d for d in self.edbs if d.name == name), None)

    def idb(self, name: str) -> RelDecl | None:
        return next((d for d in self.idbs if d.name == name), None)

    def rules_of(self, name: str) -> list[Rule]:
        return [r for r in self.rules if r.head.name == name]

    def __str__(self) -> str:
        return program_to_dl(self)


def program_to_dl(program: Program, hints: bool = True) -> str:
    """Program text that parses to an equal program; ``hints=False`` leaves .plan, .sip and .optimize out."""

    def declared(section: str, decls: tuple[RelDecl, ...], word: str) -> list[str]:
        return [section, *(f".decl {d}" + (f" {word} {d.path}" if d.path else "") for d in decls)] if decls else []

    def hint(rule: Rule) -> str:
        return {(True, True): " .optimize", (True, False): " .plan", (False, True): " .sip"}.get((rule.plan, rule.sip), "") if hints else ""

    lines = [*declared(".in", program.edbs, ".input"), *declared(".out", program.idbs, ".output")]
    if program.rules:
        lines += [".rule", *(f"{r}{hint(r)}" for r in program.rules)]
    return "\n".join(lines) + "\n"
