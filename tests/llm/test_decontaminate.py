import random
import re

import duckdb
import pytest

from fixlog.llm import decontaminate as D


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, items):
    out = {}
    for d, t in docs:
        s = shingles(t)
        for i, x in items:
            q = shingles(x)
            if d is not None and i is not None and q and len(q & s) >= 0.8 * len(q) - 1e-9:
                new = (round(len(q & s) / len(q), 6), len(q), len(q & s))
                out[d, i] = max(out.get((d, i), new), new)
    return out


def got(docs, items, **kw):
    rows = D.contained(docs, items, **kw).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): (r.containment, r.n_item_shingles, r.n_shared) for r in rows}


@pytest.mark.parametrize("least,small", [(3, 10**6), (40, 10**6), (12, 0)])
def test_planted(spark, least, small, monkeypatch):
    """Items of all sizes in short and long texts, whole, damaged, and broken up; dealt joins and broadcast ones."""
    monkeypatch.setattr(D, "SMALL", small)
    rng = random.Random(least)
    text = lambda n: [f"t{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, text(rng.randrange(least, least + 50))) for i in range(30)]
    docs = []
    for d in range(120):
        body = text(rng.choice([0, 5, 60, 800, 4000]))
        for _ in range(rng.choice([0, 1, 2])):
            x = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                x[rng.randrange(len(x))] = "damage"
            k = rng.randrange(len(body) + 1)
            body[k:k] = x
        docs.append((d, " ".join(body)))
    items = [(i, " ".join(x)) for i, x in items]
    want = brute(docs, items)
    assert len(want) > 40
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")) == want


def test_bits():
    assert D.extra_bits(1, 0.8, 1e-9) is None and D.extra_bits(200, 0.8, 1e-9) == 0
    assert D.extra_bits(30, 0.8, 1e-9) > 0


def test_odd(spark, odd, odd_rows, empty):
    texts = [odd_rows[8][1], "a b c d", None, "", "  Z é", odd_rows[8][1]]
    items = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], "x", "y"), (None, "one", "x", "y")]
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string, h string")
    docs = [(r[0], r[1]) for r in odd_rows]
    assert got(odd, table) == brute(docs, [i[:2] for i in items])
    assert got(empty, table) == {} and got(odd, table.limit(0)) == {}
    kept = D.clean(odd, table)
    assert kept.columns == odd.columns
    hit = {d for d, _ in brute(docs, [i[:2] for i in items])}
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.filter(~odd.doc_id.isin(list(hit)) | odd.doc_id.isNull()).collect()))


def test_oracle(spark, sample):
    documents, benchmark = sample.toPandas(), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").toPandas()  # noqa: F841
    want = {(r[0], r[1]): (r[4], r[2], r[3]) for r in duckdb.sql(D.oracle()).fetchall()}
    assert want and got(sample, spark.createDataFrame(benchmark)) == want
