"""Semi-naive evaluation of one group of mutually recursive relations.

Each round derives only from what the last round added. A set relation keeps
the rows that are new, MIN and MAX those that improve, SUM and COUNT add up
contributions. Inputs that don't change are persisted once, dealt by the
columns on which the recursive atom meets them, so they aren't shuffled again.
What is new meets the relation so far; a large relation stays in place while
what is new is small. The new rows of each round go to the shared checkpoint
folder, so plans stay as small as one round and a lost executor costs at most
that round; a relation is the union of its rounds, made one every ``CUT`` rounds.
"""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.syntax import ProgramError, Rule, Var, variables
from .rules import RulePlan, merge, named

#: Rounds whose rows stand apart before they are made one table.
CUT = 8
#: Rows from which on a relation isn't shuffled to meet few candidates. Below, one job less counts for more.
IN_PLACE = 1_000_000


class NoFixpoint(RuntimeError):
    """The rounds allowed didn't suffice."""


@dataclass(frozen=True)
class Round:
    """What a round of a group did."""

    relations: tuple[str, ...]
    number: int
    rows: int
    seconds: float


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable: in the folder that spark.checkpoint.dir names; a folder of our own only where it is unset and one process does all."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="fixlog-"))
    return df.checkpoint()


@dataclass
class _State:
    """A relation of the group: the rows of each round, those of the last one apart."""

    aggregate: str | None
    parts: list[DataFrame]
    delta: DataFrame
    rows: int
    n_old: int = 0
    total: int = 0

    def full(self) -> DataFrame:
        return self._one(self.parts)

    def old(self) -> DataFrame:
        return self._one(self.parts[: self.n_old] or [self.delta.limit(0)])

    def _one(self, parts: list[DataFrame]) -> DataFrame:
        if self.aggregate is None or len(parts) == 1:
            return reduce(DataFrame.unionAll, parts)  # each round has new rows only
        return merge(parts, self.aggregate)


class Fixpoint:
    def __init__(self, spark: SparkSession, group: list[str], rules: list[Rule], plan: Callable[[Rule], RulePlan], closed: Callable[[str], DataFrame], aggregates: dict[str, str | None], types: dict[str, list[str]], max_rounds: int):
        self.spark, self.group, self.plan, self.closed, self.max_rounds = spark, group, plan, closed, max_rounds
        self.aggregates, self.types = aggregates, types
        self.base = [r for r in rules if not any(a.name in group for a in r.atoms)]
        self.step = [r for r in rules if r not in self.base]
        self.rounds: list[Round] = []
        self.held: list[DataFrame] = []
        self.dealt: dict[tuple, DataFrame] = {}
        for r in self.step:
            self._check(r)

    def _additive(self, name: str) -> bool:
        return self.aggregates[name] in ("SUM", "COUNT")

    def _check(self, r: Rule) -> None:
        """Contributions of a SUM or COUNT can't be added up through every rule."""
        inside = [a for a in r.atoms if a.name in self.group]
        if any(self._additive(a.name) for a in inside):
            if len(inside) > 1:
                raise ProgramError(f"{r.head.name} joins a SUM or COUNT of its own recursion with another relation of it")
            if not self._additive(r.head.name) and self.aggregates[r.head.name] is not None:
                raise ProgramError(f"{r.head.name} aggregates a SUM or COUNT of its own recursion by {self.aggregates[r.head.name]}")
            if self.aggregates[r.head.name] is None:
                raise ProgramError(f"{r.head.name} reads a SUM or COUNT of its own recursion without adding it up")

    def _rows(self, df: DataFrame, name: str) -> DataFrame:
        return named(df, self.types[name])

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist()
        self.held.append(df)
        return df

    def _input(self, r: Rule, k: int, driver: int) -> DataFrame:
        """A closed relation, kept over the rounds and dealt by what it shares with the recursive atom."""
        atom = r.atoms[k]
        own = {v: p for p, e in reversed(list(enumerate(atom.args))) if isinstance(e, Var) for v in [e.name]}
        shared = sorted({v for e in r.atoms[driver].args for v in variables(e)} & set(own))
        key = (atom.name, tuple(own[v] for v in shared))
        if key not in self.dealt:
            df = self.closed(atom.name)
            if shared:
                df = df.repartition(*[F.col(f"c{own[v]}") for v in shared])
            self.dealt[key] = self._keep(df)
        return self.dealt[key]

    def run(self) -> dict[str, DataFrame]:
        began = time.time()
        states: dict[str, _State] = {}
        for name in self.group:
            parts = [self._rows(self.plan(r).build([self.closed(a.name) for a in r.atoms]), name) for r in self.base if r.head.name == name]
            seed = checkpoint(merge(parts, self.aggregates[name])) if parts else self._empty(name)
            states[name] = _State(self.aggregates[name], [seed], seed, seed.count() if parts else 0)
            states[name].total = states[name].rows
        self.rounds.append(Round(tuple(self.group), 0, sum(s.rows for s in states.values()), time.time() - began))
        number = 0
        while any(s.rows for s in states.values()):
            number += 1
            if number > self.max_rounds:
                raise NoFixpoint(f"{', '.join(self.group)}: new rows after {self.max_rounds} rounds")
            began = time.time()
            found = {name: self._derive(name, states) for name in self.group}
            new = {name: checkpoint(self._new(c, states[name])) for name, c in found.items() if c is not None}
            for name, s in states.items():
                s.n_old, s.rows = len(s.parts), 0
                if name in new and (rows := new[name].count()):
                    s.delta, s.rows = new[name], rows
                    s.total += rows
                    s.parts.append(s.delta)
                    if s.n_old >= CUT:
                        s.parts = [checkpoint(s.old()), s.delta]
                        s.n_old = 1
            self.rounds.append(Round(tuple(self.group), number, sum(s.rows for s in states.values()), time.time() - began))
        for df in self.held:  # results stand in the checkpoint folder
            df.unpersist()
        return {name: s.full() for name, s in states.items()}

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"c{k} {t}" for k, t in enumerate(self.types[name])))

    def _derive(self, name: str, states: dict[str, _State]) -> DataFrame | None:
        """This round's candidates: each recursive atom in turn takes the delta, earlier ones the full relation, later ones the old."""
        parts = []
        for r in self.step:
            if r.head.name != name:
                continue
            recursive = [k for k, a in enumerate(r.atoms) if a.name in self.group]
            for driver in recursive:
                if not states[r.atoms[driver].name].rows:
                    continue
                inputs = []
                for k, a in enumerate(r.atoms):
                    if k == driver:
                        inputs.append(states[a.name].delta)
                    elif k in recursive:
                        inputs.append(states[a.name].full() if k < driver else states[a.name].old())
                    else:
                        inputs.append(self._input(r, k, driver))
                parts.append(self._rows(self.plan(r).build(inputs, driver), name))
        if not parts:
            return None
        aggregated = all(r.aggregate for r in self.step if r.head.name == name)
        return merge(parts, self.aggregates[name], single=aggregated)

    def _new(self, candidates: DataFrame, s: _State) -> DataFrame:
        """The candidates that add to the relation, in the checkpoint folder.

        Where the relation is large they are held first, so that Spark knows
        their size: few are broadcast to the relation, which stays in place, and
        only the rows that they meet are shuffled.
        """
        if s.aggregate in ("SUM", "COUNT"):
            return checkpoint(candidates)
        unmet = self._unmet if s.aggregate is None else self._better
        if s.total < IN_PLACE:
            return checkpoint(unmet(candidates, s, False))
        held = candidates.persist()
        held.count()
        new = checkpoint(unmet(held, s, True))
        held.unpersist()
        return new

    def _unmet(self, candidates: DataFrame, s: _State, in_place: bool) -> DataFrame:
        """In sets nulls are values: one key struct makes them equal."""
        key = F.struct(*candidates.columns)
        known = s.full().select(key.alias("known"))
        if in_place:
            known = known.join(candidates.select(key.alias("key")), F.col("known") == F.col("key"), "left_semi")
        return candidates.join(known, key == F.col("known"), "left_anti")

    def _better(self, candidates: DataFrame, s: _State, in_place: bool) -> DataFrame:
        *keys, last = candidates.columns
        known = s.full().withColumnRenamed(last, "known")
        if in_place and keys:
            known = known.join(candidates.select(*keys), keys, "left_semi")
        better = F.col(last) < F.col("known") if s.aggregate == "MIN" else F.col(last) > F.col("known")
        joined = candidates.join(known, keys, "left") if keys else candidates.join(known, F.lit(True), "left")
        return joined.filter(F.col("known").isNull() | better).select(*keys, last)
