"""What the operators share: scratch tables in the shared folder and column checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's bound on an Arrow batch, in bytes; by default only rows are bounded in effect.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key of more than one in so many rows is hot.
HOT = 1000

#: Paths that still stand, and what deletes them.
_made: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing, and all tasks run in this process, a
    temporary folder is made and recorded as the session's checkpoint folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="fixlog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the application ends if not before."""
    path = f"{shared_dir(spark)}/fixlog-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_all)
    # works after the session has been stopped, too, as the JVM still runs then
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    _made[path] = lambda: where.getFileSystem(conf).delete(where, True)
    return path


def drop_path(path: str) -> None:
    _made.pop(path, lambda: None)()


def drop_all() -> None:
    """Removes the scratch tables that still stand."""
    while _made:
        _, delete = _made.popitem()
        try:
            delete()
        except Exception:  # the JVM is gone: the folder belongs to the cluster's own clean-up
            _made.clear()


def standing() -> set[str]:
    """The paths of the scratch tables that stand."""
    return set(_made)


def drop_new(before: set[str]) -> None:
    """Removes the scratch tables that weren't there ``before``."""
    for path in [p for p in _made if p not in before]:
        drop_path(path)


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when these end: for plans that aren't run again."""
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Queries run inside hand Python their rows in Arrow batches of about ``size`` bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH, None) is not None:
        yield
        return
    spark.conf.set(BATCH, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH)


class Scratch:
    """The tables of one operator's run, each dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back.

        The files outlive lost executors, so a later stage never has to run the
        plan above again, and its shuffle files can go.
        """
        path = scratch_path(self.spark, label)
        with cleaned_up(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Removes the tables of these labels, which no later plan may read."""
        for label in labels:
            for path in self.paths.pop(label, ()):
                drop_path(path)


def table(df: DataFrame, label: str) -> DataFrame:
    """A scratch table that stands until the application ends."""
    return Scratch(df.sparkSession).table(df, label)


def counted_join(rows: DataFrame, keys: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """``rows`` joined with ``keys``, of which column ``rows`` tells how many of ``rows`` each has at least; without that column.

    Keys of more than one in ``hot`` of all rows are fewer than ``hot``: these
    are broadcast, so that their rows stay where they are. The others are dealt.
    Both inputs are read twice, so they should be tables.
    """
    least = keys.agg(F.sum("rows")).first()[0] or 0
    heavy = F.col("rows") > least / hot
    few = keys.filter(heavy).drop("rows")
    return rows.join(F.broadcast(few), on).unionByName(rows.join(F.broadcast(few.select(on)), on, "left_anti").join(keys.filter(~heavy).drop("rows"), on))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
