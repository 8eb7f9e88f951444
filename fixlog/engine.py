"""The engine: relations by name, programs as text, results as DataFrames."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.library import Function, built_in
from .operators.fixpoint import Fixpoint, Round
from .operators.rules import Options, RulePlan, merge, named
from .plans.analysis import check
from .plans.render import rule_sql
from .plans.strata import strata
from .plans.syntax import Program, ProgramError, Rule, Var, parse

_WIDE = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


@dataclass
class Result:
    """The derived relations of a program, by name, and how they came about."""

    relations: dict[str, DataFrame]
    strata: list[tuple[list[str], bool]]
    rounds: list[Round]
    sql: dict[str, list[str]]

    def __getitem__(self, name: str) -> DataFrame:
        return self.relations[name]

    def sizes(self) -> dict[str, int]:
        """The number of rows of each relation."""
        return {name: df.count() for name, df in self.relations.items()}

    def show(self, n: int = 20) -> None:
        """Prints the first ``n`` rows of each relation under its name."""
        for name, df in self.relations.items():
            print(name)
            df.show(n, truncate=False)

    def write(self, path: str, format: str = "parquet", mode: str = "error") -> None:
        """Writes each relation to a folder of its name under ``path``."""
        for name, df in self.relations.items():
            df.write.format(format).mode(mode).save(f"{path.rstrip('/')}/{name}")

    def explain(self) -> str:
        """Strata in order, each with its rules as SQL and the rounds it took."""
        lines = []
        for k, (group, recursive) in enumerate(self.strata):
            lines.append(f"stratum {k}: {', '.join(group)}{' (recursive)' if recursive else ''}")
            lines += [f"  {q}" for name in group for q in self.sql[name]]
            lines += [f"  round {r.number}: {r.rows} rows, {r.seconds:.2f} s" for r in self.rounds if list(r.relations) == group]
        return "\n".join(lines)


class Engine:
    """Holds relations and functions, and runs programs over them.

    ``semi_join`` and ``eager_aggregation`` choose plans, never results.
    """

    def __init__(self, spark: SparkSession, *, semi_join: bool = True, eager_aggregation: bool = True, max_iterations: int = 1000):
        self.spark, self.options, self.max_iterations = spark, Options(semi_join, eager_aggregation), max_iterations
        self.functions: dict[str, Function] = built_in()
        self.frames: dict[str, DataFrame] = {}
        self.names: dict[str, list[str]] = {}

    def register(self, name: str, df: DataFrame, keys: list[str] | None = None, distinct: bool = True) -> Engine:
        """Makes ``df`` a relation; columns count by position. Rows are a set: pass ``distinct=False`` if they are unique already."""
        if not name[:1].islower():
            raise ProgramError(f"a relation's name begins with a small letter: {name}")
        types = [_WIDE.get(t, t) for _, t in df.dtypes]
        rows = named(df, types)
        if keys:
            rows = rows.repartition(*[F.col(f"c{df.columns.index(k)}") for k in keys])
        self.frames[name], self.names[name] = rows.distinct() if distinct else rows, list(df.columns)
        return self

    def register_graph(self, vertices: DataFrame, edges: DataFrame, distinct: bool = True) -> Engine:
        """``vertices(id, label)``, ``edges(src, dst, w)``, ``outgoingNeighbors(v, dst, w)`` and ``incomingNeighbors(v, src, w)``."""
        self.register("vertices", vertices, distinct=distinct)
        self.register("edges", edges, distinct=distinct)
        src, dst, *rest = edges.columns
        self.register("outgoingNeighbors", edges, distinct=distinct)
        return self.register("incomingNeighbors", edges.select(dst, src, *rest), distinct=distinct)

    def register_udf(self, name: str, function: Callable[..., Column], arity: int, result_type: str) -> Engine:
        """Makes ``function`` (columns to a column: native, or a pandas_udf) callable as ``name``, which begins with a capital."""
        if not name[:1].isupper():
            raise ProgramError(f"a function's name begins with a capital: {name}")
        self.functions[name] = Function(arity, function, result_type)
        return self

    def run(self, text: str) -> Result:
        """Runs a program. Relations that aren't recursive are lazy; recursive ones are closed before this returns."""
        program, types, aggregates = check(parse(text), {n: [t for _, t in d.dtypes] for n, d in self.frames.items()}, self.functions)
        order = strata(program)
        frames = dict(self.frames)
        rounds: list[Round] = []
        groups = {n for n, a in aggregates.items() if a}

        def plan(rule: Rule) -> RulePlan:
            return RulePlan(rule, self.spark, self.functions, self.options, groups.__contains__)

        for group, recursive in order:
            rules = [r for r in program.rules if r.head.name in group]
            if recursive:
                self._warn(group, rules, aggregates)
                loop = Fixpoint(self.spark, group, rules, plan, frames.__getitem__, aggregates, types, self.max_iterations)
                frames |= loop.run()
                rounds += loop.rounds
                continue
            (name,) = group
            parts = [named(plan(r).build([frames[a.name] for a in r.atoms]), types[name]) for r in rules]
            frames[name] = merge(parts, aggregates[name], single=all(r.aggregate for r in rules))
        columns = {n: [f"c{k}" for k in range(len(d.columns))] for n, d in frames.items()}
        sql = {h: [rule_sql(r, columns) for r in program.rules if r.head.name == h] for h in program.heads()}
        return Result({h: self._titled(program, h, frames[h]) for h in program.heads()}, order, rounds, sql)

    def run_file(self, path: str) -> Result:
        """Runs the program in a file that Spark can read; a folder's files count as one program, in order of their names."""
        rows = self.spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name")).collect()
        if not rows:
            raise ProgramError(f"no program in {path}")
        return self.run("\n".join(r.value for r in sorted(rows, key=lambda r: r.name)))

    @staticmethod
    def _titled(program: Program, head: str, df: DataFrame) -> DataFrame:
        """Columns by the head's variables where these tell them apart; else F0, F1, ..."""
        args = next(r for r in program.rules if r.head.name == head).head.args
        names = [e.name if isinstance(e, Var) else f"F{k}" for k, e in enumerate(args)]
        return df.toDF(*[n if [x.lower() for x in names].count(n.lower()) == 1 else f"F{k}" for k, n in enumerate(names)])

    @staticmethod
    def _warn(group: list[str], rules: list[Rule], aggregates: dict[str, str | None]) -> None:
        """Sums over cycles never end; ``:->`` says that there are none."""
        for r in rules:
            inside = [a for a in r.atoms if a.name in group]
            if inside and aggregates[r.head.name] in ("SUM", "COUNT") and not r.stratified and not any(r.conditions):
                warnings.warn(f"{r.head.name} adds up along its own recursion: it ends only on acyclic data", stacklevel=3)


def run(spark: SparkSession, text: str, relations: dict[str, DataFrame], **options) -> Result:
    """Runs a program over DataFrames given by name."""
    engine = Engine(spark, **options)
    for name, df in relations.items():
        engine.register(name, df)
    return engine.run(text)
