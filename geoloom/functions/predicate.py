"""Filter conditions given as nested dicts, compiled to a Column.

``and``, then ``or``, then ``not``, then ``field`` decide what a dict means; the
first of these keys that is there wins. Otherwise each key is a field, with a
value it must equal or a dict of operators that must all hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import is_text

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "startswith", "endswith", "regex", "exists", "is_null", "between")


def path(df: DataFrame, name: str) -> Column | None:
    """A column by dotted path, numbers as list places; None if its first part is no column."""
    if name in df.columns:
        return F.col(f"`{name}`")
    first, *rest = name.split(".")
    if first not in df.columns:
        return None
    out = F.col(f"`{first}`")
    for part in rest:
        out = F.get(out, int(part)) if part.isdigit() else out.getField(part)
    return out


def _test(df: DataFrame, name: str, op: str, value, case_sensitive: bool) -> Column:
    column = path(df, name)
    if op == "exists":
        return F.lit((column is not None) == bool(value))
    if column is None:
        return F.lit(bool(value) if op == "is_null" else False)
    folded = not case_sensitive and (name not in df.columns or is_text(df, name))
    fold = (lambda x: x.lower() if isinstance(x, str) else x) if folded else (lambda x: x)
    left = F.lower(column) if folded and (name in df.columns) else column
    literal = lambda x: F.lit(fold(x))
    sure = lambda c: F.coalesce(c, F.lit(False))
    member = lambda: _any([left.eqNullSafe(literal(x)) for x in value])
    made = {
        "eq": lambda: left.eqNullSafe(literal(value)),
        "ne": lambda: ~left.eqNullSafe(literal(value)),
        "gt": lambda: sure(left > literal(value)),
        "gte": lambda: sure(left >= literal(value)),
        "lt": lambda: sure(left < literal(value)),
        "lte": lambda: sure(left <= literal(value)),
        "in": member,
        "not_in": lambda: ~member(),
        "contains": lambda: sure(F.contains(left, literal(value))),
        "startswith": lambda: sure(F.startswith(left, literal(value))),
        "endswith": lambda: sure(F.endswith(left, literal(value))),
        "regex": lambda: sure(column.rlike(("" if case_sensitive else "(?i)") + value)),
        "is_null": lambda: column.isNull() if value else column.isNotNull(),
        "between": lambda: sure(left.between(literal(value[0]), literal(value[1]))),
    }
    if op not in made:
        raise ValueError(f"unknown operator {op}; known: {', '.join(OPERATORS)}")
    if op in ("in", "not_in", "between") and not isinstance(value, (list, tuple)):
        raise ValueError(f"{op} takes a list")
    return made[op]()


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def condition(df: DataFrame, where: dict, case_sensitive: bool = False) -> Column:
    if "and" in where or "or" in where:
        both = "and" in where
        out = F.lit(both)
        for part in where["and" if both else "or"]:
            one = condition(df, part, case_sensitive)
            out = out & one if both else out | one
        return out
    if "not" in where:
        return ~condition(df, where["not"], case_sensitive)
    if "field" in where:
        return _test(df, where["field"], where.get("op", "eq"), where.get("value"), case_sensitive)
    out = F.lit(True)
    for name, value in where.items():
        for op, x in value.items() if isinstance(value, dict) else [("eq", value)]:
            out = out & _test(df, name, op, x, case_sensitive)
    return out
