"""A small condition language compiled to columns, with three outcomes.

Any referenced field that is null makes the whole condition undecided (null), whatever the rest says. Comparison is by
number where both sides look like numbers, else by text without case and extra blanks. An empty text is a value."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import normalise_label
from tabloom.functions.values import as_number

MAX_DEPTH, MAX_OPS = 64, 10_000
_TEXT_OPS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_WORDS = {ast.Eq: "is", ast.NotEq: "is not", ast.Lt: "is less than", ast.LtE: "is at most", ast.Gt: "is more than", ast.GtE: "is at least", ast.In: "is one of", ast.NotIn: "is none of"}


class ConditionError(ValueError):
    pass


def normalise(expression: str) -> str:
    """The dialects of authors in one: `is blank`, a single `=`, AND, OR, NOT."""
    parts = re.split(r"('[^']*'|\"[^\"]*\")", expression.strip())
    for i in range(0, len(parts), 2):
        t = re.sub(r"(?i)\b(\w+)\s+is\s+not\s+blank\b", r"\1 != ''", parts[i])
        t = re.sub(r"(?i)\b(\w+)\s+is\s+blank\b", r"\1 == ''", t)
        for word in ("AND", "OR", "NOT"):
            t = re.sub(rf"\b{word}\b", word.lower(), t)
        parts[i] = re.sub(r"(?<![=!<>])=(?!=)", "==", t)
    return "".join(parts)


def parse(expression: str) -> ast.expr:
    """The tree of a condition; anything outside the language is refused."""
    try:
        node = ast.parse(normalise(expression), mode="eval").body
    except SyntaxError as e:
        raise ConditionError(f"cannot be read: {e.msg}") from e

    def check(n: ast.AST, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise ConditionError("nested too deeply")
        if isinstance(n, ast.BoolOp):
            inner = n.values
        elif isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.USub)):
            inner = [n.operand]
        elif isinstance(n, ast.Compare):
            if any(type(o) not in _WORDS for o in n.ops):
                raise ConditionError("unknown comparison")
            inner = [n.left, *n.comparators]
        elif isinstance(n, (ast.List, ast.Tuple)):
            inner = n.elts
        elif isinstance(n, ast.Constant) and isinstance(n.value, (str, int, float, bool, type(None))) or isinstance(n, ast.Name):
            inner = []
        else:
            raise ConditionError(f"{type(n).__name__} is not in the language")
        for x in inner:
            check(x, depth + 1)

    check(node, 0)
    return node


def inputs(expression: str | ast.AST) -> list[str]:
    """Fields that a condition reads."""
    node = parse(expression) if isinstance(expression, str) else expression
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)})


def cost(expression: str) -> int:
    """An upper bound of the comparisons that one evaluation makes."""
    total = 0
    for n in ast.walk(parse(expression)):
        if isinstance(n, ast.Compare):
            total += sum(len(c.elts) if isinstance(c, (ast.List, ast.Tuple)) else 1 for c in n.comparators)
        elif isinstance(n, (ast.BoolOp, ast.UnaryOp)):
            total += 1
    return total


def unparse(expression: str) -> str:
    """The canonical text, which reads back to the same tree."""
    return ast.unparse(parse(expression))


def _literal(n: ast.expr):
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant):
        return -n.operand.value
    return n.value


def _operand(n: ast.expr, fields: dict[str, Column]) -> tuple[Column, Column]:
    """Text and number of a field or a literal."""
    if isinstance(n, ast.Name):
        c = fields[n.id].cast("string")
        return normalise_label(c), as_number(c)
    v = _literal(n)
    number = float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if isinstance(v, str):
        try:
            number = float(v.strip().replace(",", ""))
        except ValueError:
            number = None
    return normalise_label(F.lit(None if v is None else str(v))), F.lit(number).cast("double")


def _binary(op: type, left: ast.expr, right: ast.expr, fields: dict[str, Column]) -> Column:
    if op in (ast.In, ast.NotIn):
        if not isinstance(right, (ast.List, ast.Tuple)):
            return F.lit(False)
        hit = F.lit(False)
        for x in right.elts:
            hit = hit | _binary(ast.Eq, left, x, fields)
        return hit if op is ast.In else ~hit
    (lt, ln), (rt, rn) = _operand(left, fields), _operand(right, fields)
    use = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[_TEXT_OPS[op]]
    return F.coalesce(F.when(ln.isNotNull() & rn.isNotNull(), use(ln, rn)).otherwise(use(lt, rt)), F.lit(False))


def _build(n: ast.expr, fields: dict[str, Column]) -> Column:
    if isinstance(n, ast.BoolOp):
        out = _build(n.values[0], fields)
        for v in n.values[1:]:
            out = out & _build(v, fields) if isinstance(n.op, ast.And) else out | _build(v, fields)
        return out
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
        return ~_build(n.operand, fields)
    if isinstance(n, ast.Compare):
        out, left = F.lit(True), n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            out = out & _binary(type(op), left, right, fields)
            left = right
        return out
    if isinstance(n, ast.Constant):
        return F.lit(bool(n.value))
    text, number = _operand(n, fields)
    return F.when(number.isNotNull(), number != 0).otherwise(~text.isin("", "false", "none"))


def condition(expression: str, fields: dict[str, Column] | list[str]) -> Column:
    """struct<value boolean, reason, missing array>: value is null while undecided."""
    node = parse(expression)
    if cost(expression) > MAX_OPS:
        raise ConditionError("costs too much to evaluate")
    cols = {f: F.col(f) for f in fields} if isinstance(fields, list) else fields
    named = inputs(node)
    missing = F.array_compact(F.array(*[F.when(cols[f].isNull() if f in cols else F.lit(True), F.lit(f)) for f in named])) if named else F.array().cast("array<string>")
    value = _build(node, {f: cols.get(f, F.lit(None).cast("string")) for f in named})
    decided = F.size(missing) == 0
    return F.struct(F.when(decided, value).alias("value"), F.when(decided, "evaluated").otherwise("missing_input").alias("reason"), missing.alias("missing"))


def verdict(expression: str, fields: dict[str, Column] | list[str]) -> Column:
    """KEEP, REMOVE or UNDECIDED."""
    v = condition(expression, fields)["value"]
    return F.when(v.isNull(), "UNDECIDED").when(v, "KEEP").otherwise("REMOVE")


def legacy(expression: str, fields: dict[str, Column] | list[str]) -> Column:
    """Two outcomes only: what cannot be read or decided is false."""
    try:
        node = parse(expression)
    except ConditionError:
        return F.lit(False)
    cols = {f: F.col(f) for f in fields} if isinstance(fields, list) else fields
    return F.coalesce(_build(node, {f: cols.get(f, F.lit(None).cast("string")) for f in inputs(node)}), F.lit(False))


def typecheck(expression: str, schema: dict[str, str]) -> list[tuple[str, str]]:
    """(code, what) of each static fault against field types number, string, date, boolean."""
    node, out = parse(expression), []
    kind = lambda n: schema.get(n.id) if isinstance(n, ast.Name) else "number" if isinstance(_literal(n), (int, float)) and not isinstance(_literal(n), bool) else "boolean" if isinstance(_literal(n), bool) else "string"
    for f in inputs(node):
        if f not in schema:
            out.append(("unknown_field", f))
    for n in ast.walk(node):
        if not isinstance(n, ast.Compare):
            continue
        left = n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple)):
                    out.append(("membership_needs_list", ast.unparse(n)))
            elif not isinstance(left, (ast.List, ast.Tuple)) and not isinstance(right, (ast.List, ast.Tuple)):
                a, b = kind(left), kind(right)
                if a and b and a != b and "string" not in (a, b):
                    out.append(("incompatible_comparison", ast.unparse(n)))
                elif isinstance(op, (ast.Lt, ast.LtE, ast.Gt, ast.GtE)) and "boolean" in (a, b):
                    out.append(("ordering_not_defined", ast.unparse(n)))
            left = right
    if not isinstance(node, (ast.BoolOp, ast.Compare, ast.UnaryOp)) and not (isinstance(node, ast.Name) and schema.get(node.id) == "boolean"):
        out.append(("condition_not_boolean", ast.unparse(node)))
    return out


def plain_english(expression: str) -> str:
    """A sentence for the person who approves the condition."""

    def say(n: ast.expr) -> str:
        if isinstance(n, ast.BoolOp):
            return (" and " if isinstance(n.op, ast.And) else " or ").join(f"({say(v)})" if isinstance(v, ast.BoolOp) else say(v) for v in n.values)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return f"it is not so that {say(n.operand)}"
        if isinstance(n, ast.Compare):
            out, left = [], n.left
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(right, ast.Constant) and right.value == "" and type(op) in (ast.Eq, ast.NotEq):
                    out.append(f"{say(left)} is {'blank' if type(op) is ast.Eq else 'filled in'}")
                else:
                    out.append(f"{say(left)} {_WORDS[type(op)]} {say(right)}")
                left = right
            return " and ".join(out)
        if isinstance(n, (ast.List, ast.Tuple)):
            return ", ".join(say(e) for e in n.elts)
        if isinstance(n, ast.Name):
            return n.id.replace("_", " ")
        return repr(_literal(n)) if isinstance(_literal(n), str) else str(_literal(n))

    return say(parse(expression))


def approval_sentence(expression: str, on_true: str = "keep", on_false: str = "remove") -> str:
    fields = ", ".join(f.replace("_", " ") for f in inputs(expression))
    return f"If {plain_english(expression)}, {on_true} it; otherwise {on_false} it." + (f" If {fields} is missing, a person decides." if fields else "")


def run_test_cases(cases: DataFrame, expression: str, fields: list[str], expected: str = "expected") -> DataFrame:
    """Cases with the actual verdict and whether it is the expected one."""
    return cases.withColumn("actual", verdict(expression, fields)).withColumn("passed", F.col("actual") == F.col(expected))


#: Fixed value: name of the language, part of what is hashed.
LANGUAGE = "tabloom-conditions-1"


def expression_hash(expression: str) -> str:
    """sha256 of the language's name and the canonical text: two spellings of one rule have one hash."""
    import hashlib

    return hashlib.sha256(f"{LANGUAGE}\n{unparse(expression)}".encode()).hexdigest()
