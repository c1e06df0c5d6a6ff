"""Arithmetic and comparisons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
}


def truncating_divide(a: Column, b: Column, whole: bool) -> Column:
    """Rounds the quotient towards zero, of doubles too; division by zero is an error."""
    if whole:
        return F.call_function("div", a, b)
    quotient = a.cast("double") / b.cast("double")
    return F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)).cast("double")


def apply_operator(op: str, a: Column, b: Column, whole: bool) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "%":
        return a % b
    return truncating_divide(a, b, whole)


def compare(op: str, a: Column, b: Column) -> Column:
    return _COMPARE[op](a, b)
