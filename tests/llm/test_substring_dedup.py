import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixlog.llm import substring_dedup as S
from fixlog.llm._util import counted_join


def brute(rows, length=S.LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in S.dedup(df).collect()), key=str)


def edges(seed):
    """Passages of about the length, cut and changed at all places, periodic texts, copies."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [text(rng.randrange(190, 700)) for _ in range(6)]
    rows = []
    for i in range(70):
        p = rng.choice(passages)
        a = rng.randrange(0, 60)
        p = p[a : len(p) - rng.randrange(0, 60)]
        if rng.random() < 0.4:
            k = rng.randrange(len(p))
            p = p[:k] + "#" + p[k + rng.randrange(2) :]
        rows.append((i, text(rng.choice([0, 3, 150, 600])) + p + text(rng.choice([0, 2, 200])) + (p if rng.random() < 0.2 else "")))
    rows += [(100, "x" * 199), (101, "x" * 200), (102, "y" * 201), (103, "ab" * 150), (104, "abc" * 70 + text(50)), (105, rows[0][1]), (106, rows[0][1])]
    return rows


@pytest.mark.parametrize("seed,piece", [(1, 4096), (2, 3)])
def test_edges(spark, seed, piece, monkeypatch):
    monkeypatch.setattr(S, "PIECE", piece)
    rows = edges(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd(odd, odd_rows, empty):
    assert got(odd) == brute([(r[0], r[1]) for r in odd_rows])
    assert got(empty) == []


def test_sample(sample):
    assert got(sample) == brute([(r.doc_id, r.text) for r in sample.collect()])


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=20, max_size=120), st.integers(8, 20))
def test_equal_strings(text, length):
    buf = np.frombuffer(text.encode(), np.uint8)
    start = np.arange(len(buf) - length + 1)
    ids = S.equal_strings(buf, start, length)
    index = {}
    want = [index.setdefault(text[i : i + length], i) for i in start]
    first = {}
    assert [first.setdefault(x, i) for i, x in enumerate(ids.tolist())] == want


def test_counted_join(spark, tmp_path):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(k, 0) for k in range(2, 40)] + [(None, 5)], "k long, v long")
    keys = spark.createDataFrame([(1, 300, "a"), (2, 1, "b"), (7, 1, "c"), (99, 4, "d")], "k long, rows long, kind string")
    want = sorted([(1, i, "a") for i in range(300)] + [(2, 0, "b"), (7, 0, "c")])
    for hot in (1, 2, 1000):
        assert sorted(map(tuple, counted_join(rows, keys, ["k"], hot).collect())) == want
    assert counted_join(rows, keys.limit(0), ["k"]).count() == 0
