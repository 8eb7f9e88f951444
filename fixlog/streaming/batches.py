"""Runs a program over each micro-batch of a stream: the batch is one relation, the others stand still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine


def run_on_stream(engine: Engine, name: str, stream: DataFrame, program: str, out: str, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer (call ``start``) that hands relation ``out`` of each batch to ``sink(df, batch_id)``."""

    def batch(df: DataFrame, number: int) -> None:
        engine.register(name, df)
        sink(engine.run(program)[out], number)

    return stream.writeStream.foreachBatch(batch)
