"""A small expression language compiled to Columns.

Python syntax is parsed to an AST and every node is turned into a Column, so
the result stays inside code generation. Unknown names, calls and node kinds
are refused when the expression is compiled.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST, MOST_NODES, MOST_POWER = 1000, 200, 100


class ExpressionError(ValueError):
    """The expression can't be compiled."""


def _all_known(args: list[Column]) -> Column:
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull()
    return known


def _extreme(f: Callable[..., Column]) -> Callable[..., Column]:
    """least or greatest, null if any argument is null."""
    return lambda *args: F.when(_all_known(list(args)), f(*args) if len(args) > 1 else args[0])


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "min": _extreme(F.least),
    "max": _extreme(F.greatest),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "log": lambda x: F.when(x > 0, F.log(x.cast("double"))),
    "log10": lambda x: F.when(x > 0, F.log10(x.cast("double"))),
    "exp": F.exp,
    "floor": F.floor,
    "ceil": F.ceil,
    "int": lambda x: x.try_cast("double").try_cast("bigint"),
    "float": lambda x: x.try_cast("double"),
    "str": lambda x: x.cast("string"),
    "len": lambda x: F.length(x.cast("string")).cast("bigint"),
    "upper": F.upper,
    "lower": F.lower,
    "contains": lambda x, y: F.contains(x.cast("string"), y.cast("string")),
    "coalesce": lambda *args: F.coalesce(*args),
    "is_null": lambda x: x.isNull(),
    "clip": lambda x, lo, hi: F.when(_all_known([x, lo, hi]), F.least(F.greatest(x, lo), hi)),
    "where": lambda c, a, b: F.when(truthy(c), a).otherwise(b),
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


def truthy(x: Column) -> Column:
    """False for null, zero, the empty text and false."""
    text = x.cast("string")
    return F.coalesce(text.isNotNull() & ~text.isin("0", "0.0", "-0.0", "", "false"), F.lit(False))


def safe_div(a: Column, b: Column, default: Column | None = None) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(F.abs(b) <= 1e-12, F.lit(0.0) if default is None else default).otherwise(a / F.when(F.abs(b) > 1e-12, b))


class Compiler(ast.NodeVisitor):
    def __init__(self, names: dict[str, Column]):
        self.names = names

    def compile(self, text: str) -> Column:
        if len(text) > LONGEST:
            raise ExpressionError(f"longer than {LONGEST} characters")
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as error:
            raise ExpressionError(str(error)) from error
        if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
            raise ExpressionError(f"more than {MOST_NODES} nodes")
        return self.visit(tree.body)

    def generic_visit(self, node: ast.AST) -> Column:
        raise ExpressionError(f"{type(node).__name__} is not supported")

    def visit_Constant(self, node: ast.Constant) -> Column:
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            raise ExpressionError("unknown kind of constant")
        return F.lit(node.value)

    def visit_Name(self, node: ast.Name) -> Column:
        if node.id in self.names:
            return self.names[node.id]
        if node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        raise ExpressionError(f"unknown name {node.id}; known: {', '.join(sorted(self.names))}")

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Column:
        x = self.visit(node.operand)
        return {ast.USub: lambda: -x, ast.UAdd: lambda: x, ast.Not: lambda: ~truthy(x)}.get(type(node.op), lambda: self.generic_visit(node.op))()

    def visit_BinOp(self, node: ast.BinOp) -> Column:
        if isinstance(node.op, ast.Pow) and not (isinstance(node.right, ast.Constant) and isinstance(node.right.value, (int, float)) and abs(node.right.value) <= MOST_POWER):
            raise ExpressionError(f"powers are constants up to {MOST_POWER}")
        a, b = self.visit(node.left), self.visit(node.right)
        floored = F.floor(F.try_divide(a.cast("double"), b.cast("double")))
        made = {
            ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a.cast("double"), b.cast("double")),
            ast.FloorDiv: lambda: floored, ast.Mod: lambda: a - floored * b, ast.Pow: lambda: F.pow(a.cast("double"), b.cast("double")),
        }
        return made.get(type(node.op), lambda: self.generic_visit(node.op))()

    def visit_BoolOp(self, node: ast.BoolOp) -> Column:
        """The operand that decides, as in Python."""
        *rest, out = map(self.visit, node.values)
        for x in reversed(rest):
            out = F.when(truthy(x), out).otherwise(x) if isinstance(node.op, ast.And) else F.when(truthy(x), x).otherwise(out)
        return out

    def visit_IfExp(self, node: ast.IfExp) -> Column:
        return F.when(truthy(self.visit(node.test)), self.visit(node.body)).otherwise(self.visit(node.orelse))

    def visit_Compare(self, node: ast.Compare) -> Column:
        out, left = F.lit(True), self.visit(node.left)
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                one = self._member(left, right)
                out, left = out & (~one if isinstance(op, ast.NotIn) else one), left
                continue
            b = self.visit(right)
            made = {ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b), ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}.get(type(op))
            if made is None:
                raise ExpressionError(f"{type(op).__name__} is not supported")
            out, left = out & made(left, b), b
        return out

    def _member(self, left: Column, right: ast.AST) -> Column:
        if isinstance(right, (ast.List, ast.Tuple)):
            return F.coalesce(left.isin(*[self.visit(x) for x in right.elts]), F.lit(False)) if right.elts else F.lit(False)
        return F.coalesce(F.contains(self.visit(right), left.cast("string")), F.lit(False))

    def visit_Call(self, node: ast.Call) -> Column:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise ExpressionError("only plain calls of known functions")
        name = node.func.id
        if name == "prop":
            key = node.args[0].value if len(node.args) == 1 and isinstance(node.args[0], ast.Constant) else None
            if key not in self.names:
                raise ExpressionError(f"unknown property {key}")
            return self.names[key]
        args = [self.visit(a) for a in node.args]
        if name == "round":
            digits = node.args[1].value if len(node.args) > 1 and isinstance(node.args[1], ast.Constant) else 0
            return F.bround(args[0], int(digits))
        if name == "safe_div":
            return safe_div(*args)
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {name}; known: {', '.join(sorted([*FUNCTIONS, 'round', 'safe_div', 'prop']))}")
        try:
            return FUNCTIONS[name](*args)
        except TypeError as error:
            raise ExpressionError(f"{name}: {error}") from error


def compile_expression(text: str, names: dict[str, Column]) -> Column:
    return Compiler(names).compile(text)
