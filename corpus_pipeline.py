"""A pipeline from documents to training sequences: each stage works on all that its predecessor kept.

Language ID, then one document of each near-duplicate group, then removal of
repeated chunks, then removal of documents that contain benchmark items, then
packing. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixlog.llm import chunk_dedup, decontaminate, jaccard_join, language_id, packing
from fixlog.llm._util import cleaned_up, drop_new, scratch_path, small_batches, standing, table
from fixlog.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_small_batches(stage: Callable) -> Callable:
    """``stage`` whose tables are made with Arrow batches of a few MB: executors run it beside all that earlier stages left in their memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_id``, by which stages judge, and ``own``: whether that is the id, as where one row has it.

    For null and repeated ids it is a hash of the row. So rows that share an id
    are judged each for itself; only rows alike in all hashed columns share a
    ``row_id``. Null texts are hashed as empty ones; an empty table stays empty.
    """
    again = table(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again")), "again")
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    rows = docs.join(again, "doc_id", "left").withColumn("own", F.col("doc_id").isNotNull() & F.col("again").isNull())
    return rows.withColumn("row_id", F.when(F.col("own"), F.col("doc_id")).otherwise(hashed)).select("row_id", "own", *COLUMNS)


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose language isn't accepted, by ``row_id``: null and repeated ids stay with theirs. Columns stay as they are."""
    rows = by_row(docs)
    bad = table(language_id.identify(rows, id_col="row_id").filter(~F.col("accepted")).select(F.col("doc_id").alias("row_id")).distinct(), "rejected")
    return rows.join(bad, "row_id", "left_anti").select(*COLUMNS)


@in_small_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row whose ``row_id`` names its component (word 5-grams, Jaccard of 0.8 or more), once.

    Rows with null or repeated ids are documents of their own: one that links
    with none stays, and copies among them go as any others.
    """
    rows = by_row(docs)
    groups = jaccard_join.link(rows, id_col="row_id", width=5, tenths=8).filter("doc_id = component_id").select(F.col("doc_id").alias("row_id")).distinct()
    kept = rows.join(table(groups, "representatives"), "row_id", "left_semi")
    # only hashed names can stand twice
    return kept.filter("own").select(*COLUMNS).unionByName(kept.filter("not own").dropDuplicates(["row_id"]).select(*COLUMNS))


@in_small_batches
def remove_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts, also of rows with null or repeated ids; drops a row only if nothing but blanks is left of it."""
    left = chunk_dedup.dedup(by_row(docs), id_col="row_id", carry=["doc_id", "lang", "source", "n_chars"])
    left = left.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.select("carried.doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that contain a benchmark item, by ``row_id``."""
    return decontaminate.clean(by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_id").select(*COLUMNS)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_chunks),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: Fitted likelihoods, components, rolling hashes and a tokenizer are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet in the shared folder and read again.

    What a stage made on its way goes when it has been written, and what it was
    given too; the last result stands until the application ends.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before = standing() - {last}
        path = scratch_path(spark, f"pipeline-{name}")
        with cleaned_up(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_new(before | {path})
        docs, last = spark.read.parquet(path), path
    return docs
