"""Graph files and the importer."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixlog.sources import graphs as G

LINES = [
    "[[0,0],[[[1,10],[],[[2,5]]],[[2,20],[[1,5]],[[3,7]]]],null,[[1,0,0],[2,0,0],[3,1,1]]]",
    "[[1,1],[[[3,10],[[2,7]],[]]],null,[[2,0,0]]]",
]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(LINES) + "\n")
    g = G.read_json_lines(spark, str(tmp_path / "g.txt"))
    assert rows(g.edges) == [(1, 2, 5), (2, 3, 7)] and rows(g.vertices) == [(1, 10), (2, 20), (3, 10)]
    lines = G.to_json_lines(g.vertices, g.edges, 2)
    again = G.from_json_lines(lines)
    assert rows(again.edges) == rows(g.edges) and rows(again.vertices) == rows(g.vertices) and lines.count() == 2
    assert rows(G.side_lines(g.vertices, g.edges)) == [("vertex\t1\t10\tedge\t1\t2\t5\t",), ("vertex\t2\t20\tedge\t2\t3\t7\t",), ("vertex\t3\t10\t",)]


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# from\tto\n10\t30\n30\t10\n20\t10\n\n20\t20\n40\t20\n")
    g = G.import_edge_list(spark, str(tmp_path / "e.txt"), orientation="dag")
    assert rows(g.edges) == [(1, 0, 1), (2, 0, 1), (3, 1, 1)] and rows(g.vertices) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    mixed = G.import_edge_list(spark, str(tmp_path / "e.txt"))
    assert rows(mixed.edges) == [(0, 2, 1), (1, 0, 1), (1, 3, 1)]


def test_dense_ids(spark):
    ids = spark.range(1000).select((F.col("id") * 37 % 1009 * 5).alias("id"))
    out = rows(G.dense_ids(ids.union(ids)))
    assert [k for _, k in out] == list(range(1000)) and [i for i, _ in out] == sorted(r.id for r in ids.collect())


@pytest.mark.parametrize("weights", ["uniform", "skewed_low", "skewed_high"])
def test_weights_and_labels(spark, weights):
    pairs = spark.range(3000).select((F.col("id") % 300).alias("a"), (F.col("id") * 7 % 311).alias("b"))
    g = G.import_edges(pairs, weights=weights, labels=5)
    w = Counter(r.w for r in g.edges.collect())
    assert min(w) >= 1 and max(w) <= 100
    low = sum(n for k, n in w.items() if k <= 10) / sum(w.values())
    assert {"uniform": 0.05 < low < 0.15, "skewed_low": low > 0.4, "skewed_high": low < 0.1}[weights]
    labels = Counter(r.label for r in g.vertices.collect())
    assert set(labels) <= {1, 2, 3, 4, 5} and labels[1] > labels[5]
    assert rows(G.import_edges(pairs, weights=weights, labels=5).edges) == rows(g.edges)
    assert G.import_edges(pairs, sample=0.3).edges.count() < 0.6 * g.edges.count()


def test_quality(spark):
    e = spark.createDataFrame([(0, 2), (0, 1), (0, 3), (1, 0), (4, 5)], "src long, dst long")
    assert rows(G.partition_quality(e, 2)) == [(4, 3)]
