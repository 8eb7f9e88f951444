import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from fixlog.llm.sharding import cuts, fits, shard_by_bytes, smallest_capacity


def least(sizes, shards):
    """Minimax by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(1, 5))
def test_capacity_is_least(sizes, shards):
    capacity = smallest_capacity(sizes, shards)
    assert capacity == (least(sizes, shards) if sizes else 0)
    at = [0, *cuts(sizes, shards), len(sizes)]
    assert len(at) == shards + 1 and at == sorted(at)
    assert max((sum(sizes[a:b]) for a, b in zip(at, at[1:])), default=0) <= capacity


def test_fits():
    assert fits([0, 3, 5, 9], 2, 5) and not fits([0, 3, 5, 9], 2, 4)


def check(rows, out, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((d is not None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, where, size = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return size


def test_odd(odd, odd_rows):
    check([(r[0], r[1]) for r in odd_rows], shard_by_bytes(odd, 5).collect(), 5)


def test_empty(empty):
    assert shard_by_bytes(empty, 40).collect() == []


def test_sample(sample):
    size = check([(r.doc_id, r.text) for r in sample.collect()], shard_by_bytes(sample, 8).collect(), 8)
    assert len(size) == 8 and max(size.values()) < 1.5 * sum(size.values()) / 8


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr("fixlog.llm.sharding.HOT_ROWS", 50)
    df = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check(rows, shard_by_bytes(df, 4).collect(), 4)
