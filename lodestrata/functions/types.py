"""Column types of declarations. More may be registered: a name, the Spark type and a parser of one cell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


@dataclass(frozen=True)
class ColumnType:
    name: str
    spark: T.DataType
    parse: Callable[[str], object]
    numeric: bool = False


_types: dict[str, ColumnType] = {}


def register_type(column_type: ColumnType) -> None:
    _types[column_type.name] = column_type


def type_names() -> list[str]:
    """Longer names first, so that one name may begin with another."""
    return sorted(_types, key=lambda n: (-len(n), n))


def column_type(name: str) -> ColumnType:
    return _types[name]


register_type(ColumnType("number", T.LongType(), int, True))
register_type(ColumnType("float", T.DoubleType(), float, True))
register_type(ColumnType("string", T.StringType(), str))


def type_of_value(value: object) -> str:
    return "string" if isinstance(value, str) else "float" if isinstance(value, float) else "number"


def unify(a: str | None, b: str | None) -> str | None:
    """The type of values of both; None says they don't mix."""
    if a is None or b is None or a == b:
        return a or b
    return "float" if {a, b} == {"number", "float"} else None


def literal(value: int | float | str) -> Column:
    return F.lit(value).cast(column_type(type_of_value(value)).spark)
