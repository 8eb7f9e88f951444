"""A Spark-native engine for recursive rules over graphs and tables."""

from .engine import Engine, Result, run
from .operators.fixpoint import NoFixpoint
from .plans.syntax import ProgramError, parse

__all__ = ["Engine", "NoFixpoint", "ProgramError", "Result", "parse", "run"]
