import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fixlog.llm import packing, token_files
from fixlog.llm._arrays import chunks
from fixlog.llm._bpe import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", "  ", "a  b", "foo\u00a0 bar", "x<|endoftext|>y <|startoftext|>", "it's  the\n\n  They'll", "\n", "a\u2003 b c", "ﬁ Ⅻ ǅ İstanbul ΣΑΣ", "e\u0301 \u0301x", "日本語 テスト", "\x1cab \x1d c", "don't'S 'Tis 12345 3.14", None, "🙂🙂 👩‍👩‍👧", "tail  ", "ab\r\ncd\t\tef", "aaaaaaa aaaa aaa", "\ufeffx", "a\u200bb"]


def ids_of(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encoded(name, texts, size):
    out = []
    for t in chunks(pa.array(texts, pa.string()), size):
        ids, sizes = encoder(public_tokenizers.path(name)).encode(t)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name, sample):
    texts = ODD + [r.text for r in sample.collect()]
    want = list(map(ids_of(name), texts))
    assert encoded(name, texts, 1 << 20) == want and encoded(name, texts, 50) == want


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\u00a0abcABé1'.,-s<|tŠ\u2009\u0301"), max_size=30), max_size=5))
def test_ids_of_any_text(name, texts):
    assert encoded(name, texts, 1 << 20) == list(map(ids_of(name), texts))


@pytest.mark.parametrize("name", FILES)
def test_cache_starts_anew(name, sample, monkeypatch):
    monkeypatch.setattr("fixlog.llm._bpe.KEPT_PIECES", 500)
    texts = [r.text for r in sample.limit(20).collect()]
    assert encoded(name, texts, 2000) == list(map(ids_of(name), texts))


def packed(df, rows, **kw):
    ids = ids_of(FILES[0])
    out = packing.pack(df, public_tokenizers.path(FILES[0]), **kw).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t in rows:
        x = np.array([*ids(t), 1], "<u4")
        for a in range(0, len(x), 2048):
            want[d, len(x)].append((a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048])))
    assert {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in out) / (2048 * len(sequences)) if out else None


def test_pack_odd(odd, odd_rows, empty):
    packed(odd, [(r[0], r[1]) for r in odd_rows], group_pieces=20)
    assert packed(empty, []) is None


def test_pack_sample(sample):
    assert packed(sample, [(r.doc_id, r.text) for r in sample.collect()]) > 0.98


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_first_fit_decreasing(sizes):
    """Against a scan of all bins."""
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 20)
    room, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((i for i, r in enumerate(room) if r >= sizes[k]), None)
        if b is None:
            b = len(room)
            room.append(20)
        want[k] = (b, 20 - room[b])
        room[b] -= sizes[k]
    assert {k: (bins[k], offsets[k]) for k in range(len(sizes))} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70000), max_size=50))
def test_coding_round_trip(numbers):
    control, data = token_files.encode_ranks(np.array(numbers, np.uint32))
    got = token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(numbers))
    assert got.tolist() == numbers
    assert len(control) == -(-len(numbers) // 4)


def read_back(df, rows, **kw):
    ids = ids_of(FILES[1])
    out = token_files.round_trip(df, public_tokenizers.path(FILES[1]), **kw).collect()
    before, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = np.array([*ids(t), 2], "<u4")
        want.append((d, len(x), zlib.crc32(x)))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[0])
    for r in got:
        assert r[0] == before
        before += r[2]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert list(map(key, [g[1:] for g in got])) == list(map(key, want))
    assert sorted(map(str, (g[1:] for g in got))) == sorted(map(str, want))


def test_files_odd(odd, odd_rows, empty, monkeypatch):
    monkeypatch.setattr("fixlog.llm.token_files.BLOCK_IDS", 100)
    read_back(odd, [(r[0], r[1]) for r in odd_rows])
    assert token_files.round_trip(empty, public_tokenizers.path(FILES[1])).collect() == []


def test_files_sample(sample):
    read_back(sample, [(r.doc_id, r.text) for r in sample.collect()], **{})


def test_many_files(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12), "word%d x" % i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = token_files.scratch_path(spark, "t")
    token_files.write(df, path, public_tokenizers.path(FILES[1]), end_id=2, file_bytes=500)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows) and len({r.part for r in got}) > 3


def test_ranks_are_of_the_whole_corpus(spark):
    """The rank table holds every id by its frequency over all files; rows of a hot id fill several."""
    rng = random.Random(4)
    rows = [(7 if i % 3 else rng.randrange(100), " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(9)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = token_files.scratch_path(spark, "t")
    token_files.write(df, path, public_tokenizers.path(FILES[1]), end_id=2, file_bytes=500)
    ids = ids_of(FILES[1])
    n = Counter(x for _, t in rows for x in [*ids(t), 2])
    got = [(r.id, r.n) for r in spark.read.parquet(path + "/ranks").orderBy("rank").collect()]
    assert got == sorted(n.items(), key=lambda x: (-x[1], x[0]))
    back = token_files.read(spark, path).orderBy("start").collect()
    assert len({r.part for r in back if r.doc_id == 7}) > 3
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in back) == sorted((d, len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4"))) for d, t in rows)
    assert [r.start for r in back] == [sum(r.n_tokens for r in back[:k]) for k in range(len(back))]
