import hashlib
import random

import numpy as np
import pyarrow as pa

from fixlog.llm import chunk_dedup as C
from fixlog.llm._arrays import chunks


def pieces(text):
    (t,) = chunks(pa.array([text]))
    start, end, _ = C.cut(t)
    raw = text.encode()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def brute(rows, min_run=C.MIN_RUN):
    """By the chunks' bytes; rows of one id are one document."""
    holder = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for c in pieces(t or ""):
            holder.setdefault(c, d)
    out = []
    for d, t in rows:
        seen, kept, run, removed, spans, copies = set(), [], [], 0, 0, 0
        cs = pieces(t or "")
        for c in [*cs, None]:
            if c is not None and (c in seen or (d is not None and holder[c] < d)):
                run.append(c)
            else:
                if run and len(b"".join(run)) >= min_run:
                    removed, spans, copies = removed + len(b"".join(run)), spans + 1, copies + len(run)
                else:
                    kept += run
                run = []
                kept += [c] if c is not None else []
            seen.add(c)
        left = b"".join(kept)
        out.append((d, left.decode("utf-8", "replace"), len((t or "").encode()), len(cs), copies, removed, spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_gear():
    b = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    want = [sum(int(C._GEAR[b[i - j]]) << j for j in range(min(C.WINDOW, i + 1))) % 2**32 for i in range(len(b))]
    assert C.gear(b).tolist() == want


def test_cut_resists_shifts():
    rng = random.Random(2)
    text = " ".join("w%d" % rng.randrange(10**6) for _ in range(3000)) + "日本語" * 2000 + "x" * 5000
    a, b = pieces(text), pieces("some words put in front " + text)
    assert b"".join(a).decode() == text and max(map(len, a)) <= C.MAX
    assert len(set(a) - set(b)) <= 3
    for c in a:
        c.decode()  # no character is split


def test_batches_do_not_matter():
    texts = ["a b c " * 50, "", "tail of words " * 30, None, "é" * 999]
    for size in (1, 100, 10**6):
        got = []
        for t in chunks(pa.array(texts), size):
            start, end, at = C.cut(t)
            got += [[t.buf[a:b].tobytes() for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]])] for i in range(t.n)]
        assert got == [pieces(t or "") for t in texts]


def check(df, rows):
    got = sorted((tuple(r) for r in C.dedup(df).collect()), key=str)
    assert got == brute(rows)
    return {r[0]: r for r in got}


def test_repeated_ids(spark):
    """Rows of one id with different texts, longer and shorter: each loses what earlier ids hold, and nothing to each other."""
    rng = random.Random(4)
    text = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    a, b = text(400), text(80)
    rows = [(1, a), (2, a), (2, "short one"), (2, b), (3, b + " and more"), (3, "short one"), (2, b), (None, a + " " + a), (None, b)]
    got = [tuple(r) for r in C.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert {r[2]: r[5] for r in got if r[0] == 2} == {len(a): len(a), 9: 0, len(b): 0}


def test_carry(spark, odd, odd_rows):
    got = C.dedup(odd, carry=["host", "n_chars"]).select("doc_id", "carried.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], r[7], r[4]) for r in odd_rows), key=str)


def test_odd(odd, odd_rows, empty):
    check(odd, [(r[0], r[1]) for r in odd_rows])
    assert C.dedup(empty).collect() == []


def test_sample(sample):
    check(sample, [(r.doc_id, r.text) for r in sample.collect()])


def test_passages_are_caught(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [text(60) for _ in range(20)]
    rows = [(i, f"{text(rng.randrange(1, 200))} {passages[i % 20]} {text(rng.randrange(1, 200))}" if i < 100 else text(150)) for i in range(140)]
    out = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert sum(out[i][5] > 0 for i in range(20, 100)) >= 78
    assert not any(out[i][5] for i in range(100, 140))
