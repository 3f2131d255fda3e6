"""Syntax trees to Spark SQL expressions.

Trees become expression text that Catalyst parses, so that predicates are pushed to the scan and
arithmetic runs in generated code. Columns are given as {name: (reference, type name)}.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import type_name
from .parser import Binary, Cnf, Comparison, Literal, Name, Unary, parse_cnf, parse_expression

Columns = dict[str, tuple[str, str]]


class TypeMismatch(TypeError):
    pass


class Moment(str):
    """The reference of a date or time as a string in ISO form; it knows the column itself and its type."""

    raw: str
    kind: str

    @classmethod
    def of(cls, raw: str, kind: str) -> Moment:
        out = cls(f"cast(cast({raw} as date) as string)")
        out.raw, out.kind = raw, kind
        return out

    def against(self, op: str, day: str) -> str:
        """The comparison with a day as bounds on the column, which reach the reader; the string comparison says the same."""
        at = lambda d: f"{self.kind}'{d}'" if self.kind == "date" else f"{self.kind}'{d} 00:00:00'"
        after = str(date.fromisoformat(day) + timedelta(1))
        if op == "<":
            return f"{self.raw} < {at(day)}"
        if op == ">":
            return f"{self.raw} >= {at(after)}"
        return f"({self.raw} >= {at(day)} AND {self.raw} < {at(after)})"


def _day(x) -> str | None:
    """A literal that is a day in ISO form, but for the last one there is."""
    if not (isinstance(x, Literal) and isinstance(x.value, str) and re.fullmatch(r"\d{4}-\d\d-\d\d", x.value)):
        return None
    try:
        return x.value if date.fromisoformat(x.value) < date.max else None
    except ValueError:
        return None


def columns_of(df: DataFrame, alias: str = "") -> Columns:
    """A frame's columns by name, and by alias.name if it has an alias."""
    out = {}
    for f in df.schema:
        ref = f"`{alias}`.`{f.name}`" if alias else f"`{f.name}`"
        kind = type_name(f.dataType)
        if f.dataType.simpleString() in ("timestamp", "date", "timestamp_ntz"):
            ref = Moment.of(ref, f.dataType.simpleString())  # dates are strings in ISO form
        out[f.name] = (ref, kind)
        if alias:
            out[f"{alias}.{f.name}"] = (ref, kind)
    return out


def _lookup(name: str, columns: Columns) -> tuple[str, str]:
    if name not in columns:
        raise KeyError(f"no column {name}")
    return columns[name]


def _literal(value: int | float | str) -> tuple[str, str]:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'", "String"
    if isinstance(value, float):
        return f"{value!r}D", "Double"
    return (f"{value}" if abs(value) < 1 << 31 else f"{value}L"), "Int"


def operand(x: Name | Literal, columns: Columns) -> tuple[str, str]:
    return _lookup(x.name, columns) if isinstance(x, Name) else _literal(x.value)


def comparison(c: Comparison, columns: Columns, strict_types: bool = False) -> str:
    """Strings compare by bytes. Numbers of both types compare with each other unless types are strict; a string and a number never do."""
    (left, a), (right, b) = operand(c.left, columns), operand(c.right, columns)
    if a != b and (strict_types or "String" in (a, b)):
        raise TypeMismatch(f"{left} is {a}, {right} is {b}")
    if isinstance(left, Moment) and (day := _day(c.right)):
        return left.against(c.op, day)
    if isinstance(right, Moment) and (day := _day(c.left)):
        return right.against({"<": ">", ">": "<"}.get(c.op, c.op), day)
    return f"{left} {c.op} {right}"


def cnf_text(cnf: Cnf, columns: Columns, strict_types: bool = False) -> str:
    return " AND ".join("(" + " OR ".join(comparison(c, columns, strict_types) for c in group) + ")" for group in cnf) or "true"


def predicate(cnf: str | Cnf, columns: Columns, strict_types: bool = False) -> Column:
    return F.expr(cnf_text(parse_cnf(cnf) if isinstance(cnf, str) else cnf, columns, strict_types))


def arithmetic_text(tree, columns: Columns) -> tuple[str, str]:
    """(expression, type): two Ints give an Int, and their quotient is truncated; otherwise Double. Strings are an error."""
    if isinstance(tree, Unary):
        text, kind = arithmetic_text(tree.of, columns)
        return f"(-{text})", kind
    if isinstance(tree, Binary):
        (left, a), (right, b) = arithmetic_text(tree.left, columns), arithmetic_text(tree.right, columns)
        kind = "Int" if (a, b) == ("Int", "Int") else "Double"
        return f"({left} {'div' if tree.op == '/' and kind == 'Int' else tree.op} {right})", kind
    text, kind = operand(tree, columns)
    if kind == "String":
        raise TypeMismatch(f"{text} is a String")
    return text, kind


def arithmetic(expression, columns: Columns, legacy_assoc: bool = False) -> tuple[Column, str]:
    tree = parse_expression(expression, legacy_assoc) if isinstance(expression, str) else expression
    text, kind = arithmetic_text(tree, columns)
    return F.expr(text), kind


def names_in(tree) -> set[str]:
    """Column names of a comparison, a list of comparisons or an arithmetic tree."""
    if isinstance(tree, Name):
        return {tree.name}
    if isinstance(tree, list):
        return reduce(set.union, map(names_in, tree), set())
    if isinstance(tree, Unary):
        return names_in(tree.of)
    if isinstance(tree, Binary | Comparison):
        return names_in(tree.left) | names_in(tree.right)
    return set()
