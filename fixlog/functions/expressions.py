"""Rule expressions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.syntax import Call, Expr, Lit, Op, Var
from .library import Function


def column(e: Expr, bound: dict[str, Column], functions: dict[str, Function]) -> Column:
    if isinstance(e, Lit):
        return F.lit(e.value).cast("bigint") if isinstance(e.value, int) else F.lit(e.value)
    if isinstance(e, Var):
        return bound[e.name]
    if isinstance(e, Call):
        return functions[e.name].make(*[column(a, bound, functions) for a in e.args])
    if not isinstance(e, Op):
        raise ValueError("a wildcard has no value")
    a, b = column(e.left, bound, functions), column(e.right, bound, functions)
    match e.op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))
        case "==":
            return a == b
        case "!=":
            return a != b
        case "<":
            return a < b
        case ">":
            return a > b
        case "<=":
            return a <= b
        case ">=":
            return a >= b
        case "&&":
            return a & b
        case "||":
            return a | b
    raise ValueError(e.op)
