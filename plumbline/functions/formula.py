"""Calculated columns: arithmetic formulas compiled to column expressions.

Allowed are numbers, names of columns, + - * / // % **, comparisons, and/or/not, `a if c else b`, and the functions
abs, min, max, round, sqrt, floor, ceil, sum, if. A null reads as zero, `;` separates arguments as a comma does. What is
wrong is an error message for its column, never an exception for the table; formulas may use each other in any
order without a cycle.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_POWER = 8
_FUNCTIONS = {
    "abs": (1, 1, lambda a: F.abs(a[0])), "min": (2, 99, lambda a: F.least(*a)), "max": (2, 99, lambda a: F.greatest(*a)), "sqrt": (1, 1, lambda a: F.when(a[0] >= 0, F.sqrt(a[0]))),
    "floor": (1, 1, lambda a: F.floor(a[0]).cast("double")), "ceil": (1, 1, lambda a: F.ceil(a[0]).cast("double")), "round": (1, 2, lambda a: F.bround(a[0], 0) if len(a) == 1 else F.bround(a[0], a[1])),
    "sum": (1, 99, lambda a: reduce(lambda x, y: x + y, a)), "if": (3, 3, lambda a: F.when(a[0] != 0, a[1]).otherwise(a[2])),
}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


class FormulaError(ValueError):
    pass


def parse(text: str) -> ast.expr:
    source = text.replace(";", ",")
    source = source.replace("if(", "_if(") if "if(" in source else source
    try:
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not a formula: {text}") from e


def names_in(node: ast.expr) -> set[str]:
    called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and id(n) not in called}


def compile_formula(text: str, columns: dict[str, Column]) -> Column:
    """A double column; division by zero gives null, unknown names and forms a FormulaError."""

    def truth(c: Column) -> Column:
        return c != 0

    def as_number(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    def build(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise FormulaError(f"unknown name: {n.id}")
            return F.coalesce(columns[n.id].cast("double"), F.lit(0.0))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd | ast.Not):
            v = build(n.operand)
            return as_number(v == 0) if isinstance(n.op, ast.Not) else -v if isinstance(n.op, ast.USub) else v
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            match n.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
                case ast.FloorDiv():
                    return F.floor(F.try_divide(a, b)).cast("double")
                case ast.Mod():
                    return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))
                case ast.Pow():
                    if not (isinstance(n.right, ast.Constant) and abs(n.right.value) <= MOST_POWER):
                        raise FormulaError(f"a power must be a number up to {MOST_POWER}")
                    return F.pow(a, b)
        if isinstance(n, ast.Compare):
            sides = [build(x) for x in (n.left, *n.comparators)]
            if not all(type(o) in _COMPARE for o in n.ops):
                raise FormulaError("unknown comparison")
            return as_number(reduce(lambda x, y: x & y, [_COMPARE[type(o)](a, b) for o, a, b in zip(n.ops, sides, sides[1:], strict=False)]))
        if isinstance(n, ast.BoolOp):
            parts = [truth(build(v)) for v in n.values]
            return as_number(reduce((lambda x, y: x & y) if isinstance(n.op, ast.And) else (lambda x, y: x | y), parts))
        if isinstance(n, ast.IfExp):
            return F.when(truth(build(n.test)), build(n.body)).otherwise(build(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            name = n.func.id.lstrip("_")
            if name not in _FUNCTIONS:
                raise FormulaError(f"unknown function: {name}")
            least, most, of = _FUNCTIONS[name]
            if not least <= len(n.args) <= most:
                raise FormulaError(f"wrong number of arguments: {name}")
            if name == "round" and len(n.args) == 2:
                if not (isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, int)):
                    raise FormulaError("round takes a whole number of places")
                return of([build(n.args[0]), n.args[1].value])
            return of([build(a) for a in n.args])
        raise FormulaError(f"not allowed in a formula: {type(n).__name__}")

    return build(parse(text))


def order_of(formulas: dict[str, str], known: set[str]) -> list[str]:
    """An order in which each formula comes after those it uses; a cycle is a FormulaError that names its members."""
    needs = {}
    for name, text in formulas.items():
        try:
            needs[name] = names_in(parse(text)) & set(formulas) - ({name} if name in known else set())
        except FormulaError:
            needs[name] = set()
    out: list[str] = []
    while len(out) < len(formulas):
        ready = sorted(n for n in formulas if n not in out and needs[n] <= set(out))
        if not ready:
            raise FormulaError("formulas use each other in a circle: " + ", ".join(sorted(set(formulas) - set(out))))
        out += ready
    return out


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """df with a column for each formula that compiles, and the messages of those that do not."""
    errors: dict[str, str] = {}
    for name in order_of(formulas, set(df.columns)):
        try:
            df = df.withColumn(name, compile_formula(formulas[name], {c: F.col(c) for c in df.columns}))
        except FormulaError as e:
            errors[name] = str(e)
    return df, errors
