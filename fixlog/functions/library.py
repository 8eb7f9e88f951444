"""The built-in scalar functions as native column expressions, and the registry for users' own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    arity: int
    make: Callable[..., Column]
    type: str


def _int(x: Column) -> Column:
    """Towards zero."""
    return x.cast("double").cast("bigint")


def _share(top: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(_int(top.cast("double") * 100 / whole)).cast("bigint")


def _ap_confidence(a: Column, b: Column, c: Column) -> Column:
    # the third argument has never counted: the first stands in for it
    return _share(F.greatest(a, b), a + b + a)


def _shingle(s: Column, k: Column) -> Column:
    least = F.slice(F.array_sort(F.array_distinct(F.split(s, ""))), F.lit(1), k.cast("int"))
    return F.call_function("rpad", F.array_join(least, ""), k.cast("int"), F.lit("\u0000"))


def _str_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    none = a.rlike("[0-9]$") | b.rlike("[0-9]$") | (a == b) | (longest == 0)
    return F.when(none, F.lit(0)).otherwise(F.floor((longest - F.levenshtein(a, b)).cast("double") * 100 / longest)).cast("bigint")


def _match(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("bigint"))
    per_mille = F.when(F.length(a) == 0, F.lit(0)).otherwise(F.floor(F.aggregate(same, F.lit(0).cast("bigint"), lambda s, x: s + x) * 1000 / F.length(a)))
    return F.when(F.length(a) == F.length(b), per_mille).otherwise(F.raise_error(F.lit("Match: texts of different length")).cast("bigint")).cast("bigint")


def built_in() -> dict[str, Function]:
    return {
        "INT": Function(1, _int, "bigint"),
        "Mode": Function(2, lambda a, b: F.when(a > b, "A").otherwise("B"), "string"),
        "AP_CLASSIFY": Function(3, lambda a, b, c: F.when(a >= b, "DB").otherwise("ML"), "string"),
        "AP_CONFIDENCE": Function(3, _ap_confidence, "bigint"),
        "SHINGLE": Function(2, _shingle, "string"),
        "STR_SIM": Function(2, _str_sim, "bigint"),
        "ER_CLASSIFY": Function(2, lambda j, s: F.when((j > 10) & (s > 50), 1).otherwise(0).cast("bigint"), "bigint"),
        "ER_CONFIDENCE": Function(2, lambda j, s: _int((j + s).cast("double") / 2), "bigint"),
        "Confidence": Function(2, lambda a, b: _share(F.greatest(a, b), a + b), "bigint"),
        "LabelMatch": Function(2, lambda a, b: (a == b).cast("bigint"), "bigint"),
        "Match": Function(2, _match, "bigint"),
    }
