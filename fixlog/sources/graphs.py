"""Graph sources and sinks: JSON lines of super-vertices, edge lists, and the importer's options."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fixpoint import checkpoint


@dataclass(frozen=True)
class Graph:
    """``vertices(id, label)`` and ``edges(src, dst, w)``, each without repeats."""

    vertices: DataFrame
    edges: DataFrame


def read_json_lines(spark: SparkSession, path: str) -> Graph:
    return from_json_lines(spark.read.text(path))


def from_json_lines(lines: DataFrame) -> Graph:
    """From lines ``[[partition, id], [[[id, label], [[src, w]..], [[dst, w]..]]..], null, ..]`` in column ``value``.

    An edge inside a super-vertex stands in both its ends' lists and counts once.
    """
    parts = F.from_json(F.col("value"), "array<string>")
    vertices = lines.select(F.explode(F.from_json(F.get(parts, F.lit(1)), "array<array<string>>")).alias("v"))
    own = F.from_json(F.get("v", F.lit(0)), "array<bigint>")
    sides = [F.from_json(F.get("v", F.lit(k)), "array<array<bigint>>") for k in (1, 2)]
    rows = vertices.select(own.alias("own"), sides[0].alias("ins"), sides[1].alias("outs"))
    me = F.get("own", F.lit(0))
    into = F.transform("ins", lambda e: F.struct(F.get(e, 0).alias("src"), me.alias("dst"), F.get(e, 1).alias("w")))
    out = F.transform("outs", lambda e: F.struct(me.alias("src"), F.get(e, 0).alias("dst"), F.get(e, 1).alias("w")))
    edges = rows.select(F.explode(F.concat(into, out)).alias("e")).select("e.src", "e.dst", "e.w").distinct()
    return Graph(rows.select(me.alias("id"), F.get("own", F.lit(1)).alias("label")).distinct(), edges)


def to_json_lines(vertices: DataFrame, edges: DataFrame, super_vertices: int = 64, partitions: int = 1) -> DataFrame:
    """The same lines from a graph, one for each ``id % super_vertices``."""
    src, dst, w = edges.columns
    vid, label = vertices.columns
    pair = lambda a, b: F.array(F.col(a).cast("bigint"), F.col(b).cast("bigint"))
    ins = edges.groupBy(F.col(dst).alias("id")).agg(F.collect_list(pair(src, w)).alias("ins"))
    outs = edges.groupBy(F.col(src).alias("id")).agg(F.collect_list(pair(dst, w)).alias("outs"))
    rows = vertices.select(F.col(vid).alias("id"), F.col(label).alias("label")).join(ins, "id", "left").join(outs, "id", "left")
    none = F.array().cast("array<array<bigint>>")
    ins, outs = F.coalesce("ins", none), F.coalesce("outs", none)
    place = lambda c: F.pmod(c, F.lit(super_vertices))
    near = F.transform(F.array_distinct(F.transform(F.concat(ins, outs), lambda e: F.get(e, 0))), lambda n: F.array(n, place(n) % partitions, place(n)))
    text = F.concat(F.lit("[["), F.col("id"), F.lit(","), F.col("label"), F.lit("],"), F.to_json(ins), F.lit(","), F.to_json(outs), F.lit("]"))
    rows = rows.select(place(F.col("id")).alias("s"), text.alias("v"), near.alias("near"))
    grouped = rows.groupBy("s").agg(F.array_join(F.collect_list("v"), ",").alias("v"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return grouped.select(F.concat(F.lit("[["), F.col("s") % partitions, F.lit(","), F.col("s"), F.lit("],["), F.col("v"), F.lit("],null,"), F.to_json("near"), F.lit("]")).alias("value"))


def side_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One line per vertex: ``vertex, id, label`` and then ``edge, src, dst, w`` for each edge out of it, in order, parted by tabs."""
    tab = F.lit("\t")
    src, dst, w = edges.columns
    vid, label = vertices.columns
    out = edges.groupBy(F.col(src).alias("id")).agg(F.sort_array(F.collect_list(F.struct(dst, w))).alias("to"))
    rows = vertices.select(F.col(vid).alias("id"), F.col(label).alias("label")).join(out, "id", "left")
    edge = lambda e: F.concat(F.lit("edge\t"), F.col("id"), tab, e[dst], tab, e[w], tab)
    rest = F.coalesce(F.array_join(F.transform("to", edge), ""), F.lit(""))
    return rows.select(F.concat(F.lit("vertex\t"), F.col("id"), tab, F.col("label"), tab, rest).alias("value"))


def edge_lines(lines: DataFrame) -> DataFrame:
    """``src, dst`` from lines ``from<TAB>to`` in column ``value``; lines that begin with '#' are comments."""
    parts = F.split(F.trim("value"), "\\s+")
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.get(parts, F.lit(0)).cast("bigint").alias("src"), F.get(parts, F.lit(1)).cast("bigint").alias("dst"))


def dense_ids(ids: DataFrame) -> DataFrame:
    """``id, k``: ids in order numbered from 0, by range partitions and their counts.

    Both branches below must see the same partitions, so these are fixed in
    number and written once.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(ids.distinct().repartitionByRange(n, "id").withColumn("p", F.spark_partition_id()))
    counts = placed.groupBy("p").count()
    # one row for each partition
    before = counts.select("p", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy("id"))
    return placed.withColumn("r", inside).join(F.broadcast(before), "p").select("id", (F.col("base") + F.col("r") - 1).alias("k"))


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def zipf(u: Column, n: int, exponent: float = 1.0) -> Column:
    """1..n by the inverse of the Zipf distribution's cumulative shares."""
    weights = [1 / k**exponent for k in range(1, n + 1)]
    total, at, bounds = math.fsum(weights), 0.0, []
    for x in weights[:-1]:
        at += x / total
        bounds.append(at)
    return (F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u)) + 1).cast("bigint") if bounds else F.lit(1).cast("bigint")


def import_edges(pairs: DataFrame, *, sample: float = 1.0, orientation: str = "mixed", weights: str = "unit", labels: int = 1, seed: int = 1) -> Graph:
    """A graph from pairs of ids: sampled, made undirected, renumbered from 0 in order, then oriented and weighted.

    ``orientation``: 'dag' sends each edge from the larger to the smaller id;
    'mixed' does so where the ids' bitwise XOR is odd, else the other way.
    ``weights``: 'unit', 'uniform' (1 to 100), 'skewed_low' or 'skewed_high'
    (Zipf over 100, and its mirror). Labels are Zipf over ``labels``. Weights,
    labels and the sample are hashes of ids, so a run can be repeated.
    """
    src, dst = pairs.columns[:2]
    pairs = pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    if sample < 1:
        pairs = pairs.filter(_chance("src", "dst", F.lit(seed)) < sample)
    ids = dense_ids(pairs.select(F.explode(F.array("src", "dst")).alias("id")))
    one = ids.select(F.col("id").alias("src"), F.col("k").alias("x"))
    two = ids.select(F.col("id").alias("dst"), F.col("k").alias("y"))
    found = pairs.join(one, "src").join(two, "dst").filter("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
    down = F.lit(True) if orientation == "dag" else F.col("lo").bitwiseXOR(F.col("hi")) % 2 == 1
    u = _chance("lo", "hi", F.lit(seed + 1))
    w = {"unit": lambda: F.lit(1).cast("bigint"), "uniform": lambda: F.floor(u * 100) + 1, "skewed_low": lambda: zipf(u, 100), "skewed_high": lambda: F.lit(101) - zipf(u, 100)}[weights]()
    edges = found.select(F.when(down, F.col("hi")).otherwise(F.col("lo")).alias("src"), F.when(down, F.col("lo")).otherwise(F.col("hi")).alias("dst"), w.cast("bigint").alias("w"))
    return Graph(ids.select(F.col("k").alias("id"), zipf(_chance("k", F.lit(seed + 2)), labels).alias("label")), edges)


def import_edge_list(spark: SparkSession, path: str, **options) -> Graph:
    return import_edges(edge_lines(spark.read.text(path)), **options)


def partition_quality(edges: DataFrame, partitions: int) -> DataFrame:
    """``edge_cut``: edges across partitions ``id % partitions``; ``communication_volume``: foreign partitions each vertex sends to, summed."""
    src, dst = edges.columns[:2]
    p, q = F.pmod(F.col(src), F.lit(partitions)), F.pmod(F.col(dst), F.lit(partitions))
    across = edges.filter(p != q)
    sent = across.select(F.col(src), q.alias("q")).distinct()
    cut = across.agg(F.count(F.lit(1)).alias("edge_cut"))
    return cut.join(sent.agg(F.count(F.lit(1)).alias("communication_volume")), F.lit(True))
