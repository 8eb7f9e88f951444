"""One rule as one DataFrame plan: scans, filters, joins, and a projection or an aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import column
from ..functions.library import Function
from ..plans.analysis import uses
from ..plans.syntax import Atom, Expr, Rule, Var, Wild, variables

_MERGE = {"SUM": F.sum, "COUNT": F.sum, "MIN": F.min, "MAX": F.max}


@dataclass(frozen=True)
class Options:
    """Plans differ by these, results don't."""

    semi_join: bool = True
    eager_aggregation: bool = True


def named(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Columns c0, c1, ..., cast to the relation's types where they differ."""
    have = [t for _, t in df.dtypes]
    return df.select(*[(F.col(f"`{c}`") if types is None or types[k] == have[k] else F.col(f"`{c}`").cast(types[k])).alias(f"c{k}") for k, c in enumerate(df.columns)])


def _conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class RulePlan:
    """Builds the plan of a rule over given inputs of its atoms."""

    def __init__(self, rule: Rule, spark: SparkSession, functions: dict[str, Function], options: Options, unique: Callable[[str], bool] = lambda _: False):
        self.rule, self.spark, self.functions, self.options, self.unique = rule, spark, functions, options, unique
        self.aggregate = rule.aggregate

    def _scan(self, k: int, atom: Atom, df: DataFrame) -> tuple[DataFrame, dict[str, Column], list[tuple[Column, Expr]]]:
        """The atom's columns under names of their own, filtered by what concerns it alone."""
        df = df.select(*[F.col(f"c{p}").alias(f"a{k}_{p}") for p in range(len(atom.args))])
        bound: dict[str, Column] = {}
        later: list[tuple[Column, Expr]] = []
        for p, e in enumerate(atom.args):
            place = F.col(f"a{k}_{p}")
            if isinstance(e, Var):
                if e.name in bound:
                    df = df.filter(bound[e.name] == place)
                bound.setdefault(e.name, place)
            elif not isinstance(e, Wild):
                if variables(e):
                    later.append((place, e))
                else:
                    df = df.filter(place == column(e, {}, self.functions))
        return df, bound, later

    def _order(self, atoms: list[Atom], first: int) -> list[int]:
        """From the first atom to those connected with what is bound; unconnected ones last."""
        order, left = [first], [k for k in range(len(atoms)) if k != first]
        seen = {v for e in atoms[first].args for v in variables(e)}
        linked = [variables(c) for c in self.rule.conditions]
        while left:
            shares = lambda k: len(seen & {v for e in atoms[k].args for v in variables(e)})
            by_condition = lambda k: any(c & seen and c & {v for e in atoms[k].args for v in variables(e)} for c in linked)
            k = max(left, key=lambda k: (shares(k) > 0, by_condition(k), -k))
            order.append(k)
            left.remove(k)
            seen |= {v for e in atoms[k].args for v in variables(e)}
        return order

    def _ahead(self, atoms: list[Atom], counts) -> tuple[int, list[str]] | None:
        """Eager aggregation: the atom that has all of the aggregate's variables, and the ones to group it by."""
        if not (self.options.eager_aggregation and self.aggregate and len(atoms) > 1):
            return None
        inner = variables(self.aggregate.args[0])
        counting = self.aggregate.name == "COUNT"  # counts tuples, whatever its argument
        if not inner and not counting:
            return None
        for k, a in enumerate(atoms):
            own = {v for e in a.args for v in variables(e)}
            if any(not isinstance(e, Var | Wild) for e in a.args) or self.unique(a.name):
                continue
            elsewhere = {v for j, b in enumerate(atoms) if j != k for e in b.args for v in variables(e)} | {v for e in self.rule.head.args[:-1] for v in variables(e)} | {v for c in self.rule.conditions for v in variables(c)}
            if not counting and (not inner <= own or inner & elsewhere):
                continue
            keys = sorted(own & elsewhere)
            if len(keys) < len({v for e in a.args for v in variables(e)}):
                return k, keys
        return None

    def build(self, inputs: list[DataFrame], first: int = 0) -> DataFrame:
        """``inputs`` has the relation of each atom, columns c0, c1, ...; the result has the head's columns.

        Set heads come out with repeats removed, aggregated heads as one partial
        value per group: those of several rules are merged by ``merge``.
        """
        rule = self.rule
        positive = [(a, d) for a, d in zip(rule.atoms, inputs, strict=True) if not a.negated]
        atoms = [a for a, _ in positive]
        counts = uses(rule)
        pending: list = list(rule.conditions)
        bound: dict[str, Column] = {}
        partial: Column | None = None
        df: DataFrame | None = None
        if atoms:
            eager = self._ahead(atoms, counts)
            place = sum(1 for a in rule.atoms[:first] if not a.negated)
            order = self._order(atoms, place)
            for k in order:
                scan, own, later = self._scan(k, atoms[k], positive[k][1])
                mine = [c for c in pending if not isinstance(c, _Placed) and variables(c) and variables(c) <= set(own)]
                if mine:
                    scan = scan.filter(_conjunction([column(c, own, self.functions) for c in mine]))
                    pending = [c for c in pending if c not in mine]
                if eager and eager[0] == k:
                    value = F.count(F.lit(1)) if self.aggregate.name == "COUNT" else _MERGE[self.aggregate.name](column(self.aggregate.args[0], own, self.functions))
                    scan = scan.groupBy(*[own[v].alias(f"g{k}_{v}") for v in eager[1]] or [F.lit(1).alias(f"g{k}")]).agg(value.alias(f"g{k}_value"))
                    own, partial = {v: F.col(f"g{k}_{v}") for v in eager[1]}, F.col(f"g{k}_value")
                if df is None:
                    df, bound = scan, own
                    extra = later
                else:
                    extra = later
                    shared = [v for v in own if v in bound]
                    after = bound | {v: c for v, c in own.items() if v not in bound}
                    on = [bound[v] == own[v] for v in shared]
                    ready = [c for c in pending if not isinstance(c, _Placed) and variables(c) and variables(c) <= set(after)]
                    now = [(p, e) for p, e in extra if variables(e) <= set(after)]
                    extra = [x for x in extra if x not in now]
                    on += [column(c, after, self.functions) for c in ready] + [p == column(e, after, self.functions) for p, e in now]
                    pending = [c for c in pending if c not in ready]
                    fresh = [v for v in own if v not in bound and counts[v] > sum(isinstance(e, Var) and e.name == v for e in atoms[k].args)]
                    if not on and self.aggregate is None and not extra and not any(isinstance(c, _Placed) for c in pending):
                        # without keys each side goes in as the set of what is used of it
                        done = order[: order.index(k) + 1]
                        used = {v for e in [*rule.head.args, *pending, *(e for j, a in enumerate(atoms) if j not in done for e in a.args), *(e for a in rule.atoms if a.negated for e in a.args)] for v in variables(e)}
                        bound, own = ({v: c for v, c in x.items() if v in used} for x in (bound, own))
                        df, scan = (d.select(*x.values() or [F.lit(1).alias(f"{side}{k}")]).distinct() for d, x, side in ((df, bound, "l"), (scan, own, "r")))
                        after = bound | own
                    semi = self.options.semi_join and self.aggregate is None and on and not fresh and not extra
                    df = df.join(scan, _conjunction(on), "left_semi" if semi else "inner") if on else df.crossJoin(scan)
                    bound = bound if semi else after
                pending += [_Placed(p, e) for p, e in extra]
                placed = [x for x in pending if isinstance(x, _Placed) and variables(x.e) <= set(bound)]
                if placed:
                    df = df.filter(_conjunction([x.p == column(x.e, bound, self.functions) for x in placed]))
                    pending = [x for x in pending if x not in placed]
        else:
            df = self.spark.range(1, numPartitions=1).select(F.col("id").alias("one"))
        if pending:  # without variables too
            df = df.filter(_conjunction([column(c, bound, self.functions) for c in pending]))
        for k, (a, d) in enumerate(zip(rule.atoms, inputs, strict=True)):
            if a.negated:
                n = d.select(*[F.col(f"c{p}").alias(f"n{k}_{p}") for p in range(len(a.args))])
                on = [F.col(f"n{k}_{p}") == column(e, bound, self.functions) for p, e in enumerate(a.args) if not isinstance(e, Wild)]
                df = df.join(n, _conjunction(on) if on else F.lit(True), "left_anti")
        if self.aggregate is None:
            out = df.select(*[column(e, bound, self.functions).alias(f"c{k}") for k, e in enumerate(rule.head.args)])
            return out
        keys = [column(e, bound, self.functions).alias(f"c{k}") for k, e in enumerate(rule.head.args[:-1])]
        last = f"c{len(keys)}"
        if partial is not None:
            agg = _MERGE[self.aggregate.name](partial)
        elif self.aggregate.name == "COUNT":
            agg = F.count(F.lit(1))
        else:
            agg = _MERGE[self.aggregate.name](column(self.aggregate.args[0], bound, self.functions))
        # without a group an empty body gives no row
        grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit(1).alias("whole"))
        return grouped.agg(agg.alias(last)).select(*[f"c{k}" for k in range(len(keys) + 1)])


@dataclass(frozen=True)
class _Placed:
    """An atom's place that must equal an expression of variables bound elsewhere."""

    p: Column
    e: Expr

    def __eq__(self, other: object) -> bool:
        return self is other

    __hash__ = object.__hash__


def merge(parts: list[DataFrame], aggregate: str | None, single: bool = False) -> DataFrame:
    """The union of rules' results as one relation: a set, or one value per group.

    ``single``: the only part is grouped already.
    """
    df = reduce(DataFrame.unionAll, parts)
    if aggregate is None:
        return df.distinct()
    if single and len(parts) == 1:
        return df
    *keys, last = df.columns
    grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit(1).alias("whole"))
    return grouped.agg(_MERGE[aggregate](last).alias(last)).select(*keys, last)

