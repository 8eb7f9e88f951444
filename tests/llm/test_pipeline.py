"""The pipeline against the stages' own brute-force forms, one after the other."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fixlog.llm import language_id
from fixlog.llm._util import standing

from .test_chunk_dedup import brute as brute_chunks
from .test_decontaminate import brute as brute_items
from .test_jaccard_join import brute as brute_join


def test_stages(spark, sample, tmp_path):
    docs = sample.toPandas()
    copy = docs.iloc[[3, 7, 9]].assign(doc_id=[1003, 1007, 1009])
    odd = docs.iloc[[0, 1]].assign(doc_id=[2000, 2001], text=["¤¦▒▓ █░" * 20, None], lang=None)
    given = spark.createDataFrame([*map(tuple, docs.itertuples(index=False)), *map(tuple, copy.itertuples(index=False)), *map(tuple, odd.itertuples(index=False))], sample.schema)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == sample.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    kept = {r.doc_id: r.text for r in given.collect()}

    accepted = {r.doc_id for r in language_id.identify(given).collect() if r.accepted}
    kept = {d: t for d, t in kept.items() if d in accepted}
    assert {r.doc_id: r.text for r in seen["language_id"]} == kept
    assert not {2000, 2001} & kept.keys() and len(kept) > 0.95 * len(docs)

    kept = {d: t for d, t in kept.items() if (d, d) in {(r[0], r[2]) for r in brute_join(list(kept.items()), 8, 5)}}
    assert {r.doc_id: r.text for r in seen["jaccard_join"]} == kept
    assert not {1003, 1007, 1009} & kept.keys()

    left = {r[0]: (r[1], r[5]) for r in brute_chunks(list(kept.items()))}
    kept = {d: t for d, (t, removed) in left.items() if not removed or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r.doc_id: r.text for r in seen["substring_dedup"]} == kept
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"] if left[r.doc_id][1])

    leaks = {d for d, _ in brute_items(list(kept.items()), [(r.item_id, r.text) for r in items.collect()])}
    assert leaks
    kept = {d: t for d, t in kept.items() if d not in leaks}
    assert {r.doc_id: r.text for r in seen["decontamination"]} == kept

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(int)
    for r in seen["packing"]:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id] += r.length
    assert pieces.keys() == kept.keys() and max(sequences.values()) <= 2048
    for d, text in kept.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(pieces[d]) == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]

    before = standing()
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert len(standing() - before) == 1  # the result
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, seen["packing"]))
