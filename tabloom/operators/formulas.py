"""A formula language compiled to columns. A fault is a value: struct<value double, ok boolean, error string>."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.values import as_number

FUNCTIONS = ("round", "abs", "min", "max", "sum", "mean", "avg", "floor", "ceil", "sqrt")


class FormulaError(ValueError):
    pass


def parse(expression: str) -> ast.expr:
    try:
        node = ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"cannot be read: {e.msg}") from e
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS or n.keywords):
            raise FormulaError("not an allowed function")
        if isinstance(n, ast.Constant) and (isinstance(n.value, bool) or not isinstance(n.value, (int, float))):
            raise FormulaError("only numbers are allowed")
        if not isinstance(n, (ast.Call, ast.Constant, ast.Name, ast.BinOp, ast.UnaryOp, ast.List, ast.Tuple, ast.operator, ast.unaryop, ast.expr_context)):
            raise FormulaError(f"{type(n).__name__} is not in the language")
    return node


def identifiers(expression: str) -> list[str]:
    node = parse(expression)
    called = {n.func.id for n in ast.walk(node) if isinstance(n, ast.Call)}
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)} - called)


def formula(expression: str, fields: dict[str, Column] | list[str]) -> Column:
    """struct<value, ok, error>; a missing or non-numeric input, a division by zero and a result that is no number are
    errors, never numbers. Division is by try_divide, so no row stops a job."""
    node = parse(expression)
    cols = {f: F.col(f) for f in fields} if isinstance(fields, list) else fields
    zero: list[Column] = []

    def flat(args: list[ast.expr]) -> list[Column]:
        return [c for a in args for c in (flat(a.elts) if isinstance(a, (ast.List, ast.Tuple)) else [build(a)])]

    def build(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return as_number(cols[n.id]) if n.id in cols else F.lit(None).cast("double")
        if isinstance(n, ast.UnaryOp):
            return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            if isinstance(n.op, (ast.Div, ast.FloorDiv, ast.Mod)):
                zero.append(b == 0)
            if isinstance(n.op, ast.Div):
                return F.try_divide(a, b)
            if isinstance(n.op, ast.FloorDiv):
                return F.floor(F.try_divide(a, b)).cast("double")
            if isinstance(n.op, ast.Mod):
                return a - F.floor(F.try_divide(a, b)) * b
            if isinstance(n.op, ast.Pow):
                return F.pow(a, b)
            return a + b if isinstance(n.op, ast.Add) else a - b if isinstance(n.op, ast.Sub) else a * b
        if isinstance(n, ast.Call):
            name, args = n.func.id, flat(n.args)
            if name == "round":
                return F.bround(args[0], int(n.args[1].value) if len(n.args) > 1 else 0)
            if name in ("abs", "floor", "ceil", "sqrt"):
                return getattr(F, name)(args[0]).cast("double")
            if name in ("min", "max"):
                return args[0] if len(args) == 1 else (F.least if name == "min" else F.greatest)(*args)
            total = args[0]
            for x in args[1:]:
                total = total + x
            return total if name == "sum" else total / len(args)
        raise FormulaError("a list is not a value")

    value = build(node)
    names = identifiers(expression)
    missing = F.array_compact(F.array(*[F.when(as_number(cols[f]).isNull() if f in cols else F.lit(True), F.lit(f)) for f in names])) if names else F.array().cast("array<string>")
    divided = F.lit(False)
    for z in zero:
        divided = divided | F.coalesce(z, F.lit(False))
    error = F.when(F.size(missing) > 0, F.concat(F.lit("no number for "), F.array_join(missing, ", "))).when(divided, "division by zero").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not a finite number")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.isNull().alias("ok"), error.alias("error"))
