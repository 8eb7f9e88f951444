"""What operators leave in the memory of executors that go on with other stages."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from fixlog.llm import _arrays, _bpe, jaccard_join
from fixlog.llm._arrays import chunks
from fixlog.llm._util import BATCH, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_stages_use_small_batches(spark, tmp_path, monkeypatch):
    """A partition of 12 MB reaches Python in batches of about 4 MB; the session's own bound holds if it has one."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 2000).alias("text"), F.lit("en").alias("lang"), F.lit("h").alias("source"), F.lit(1).alias("n_chars")).coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    seen = []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def link(df, *, id_col, **_):
        r = table(df.select("text").coalesce(1).mapInArrow(sizes, "n long"), "sizes").agg(F.max("n"), F.sum("n")).first()
        seen.append(tuple(r))
        return df.select(F.col(id_col).alias("doc_id"), F.col(id_col).alias("component_id"))

    monkeypatch.setattr(jaccard_join, "link", link)
    stage = dict(C.STAGES)["jaccard_join"]
    given = spark.read.parquet(str(tmp_path / "docs"))
    assert stage(spark, given, str(tmp_path)).count() == 600
    assert seen[0][0] < 6 << 20 and seen[0][1] > 12 << 20
    assert spark.conf.get(BATCH, None) is None
    spark.conf.set(BATCH, str(1 << 20))
    try:
        stage(spark, given, str(tmp_path))
        assert seen[1][0] < 2 << 20 and spark.conf.get(BATCH) == str(1 << 20)
    finally:
        spark.conf.unset(BATCH)


def test_tidy_functions_keep_nothing():
    """Tables of a tokenizer and of fingerprints don't outlive the next task that has no use for them."""
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], names=["doc_id", "text"])
    want = list(jaccard_join._profiles(3, 9)(iter([texts])))
    _bpe.encoder(PATH)
    assert _bpe.encoder.cache_info().currsize and len(_arrays._powers[0]) > 1
    assert list(_arrays.tidy(jaccard_join._profiles(3, 9))(iter([texts]))) == want
    assert not _bpe.encoder.cache_info().currsize and len(_arrays._powers[0]) == 1
    groups = pa.table({"a": [1, 2]})
    assert _arrays.tidy(lambda t: t.slice(1))(groups).to_pylist() == [{"a": 2}]


def test_encoder_keeps_what_it_meets_again():
    """With room for few pieces those met once go, those met again stay, and ids are the library's."""
    rng = np.random.default_rng(4)
    whole = Tokenizer.from_file(PATH)
    enc = _bpe.Encoder(PATH, 600)
    for _ in range(30):
        text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(100)) + " often seen"
        for t in chunks(pa.array([text])):
            ids, sizes = enc.encode(t)
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
            start, end, _ = enc._pieces(t)
            found = enc._lookup(t.prints(start[-2:], end[-2:]))
            assert (found >= 0).all()
            # slot numbers are given anew when pieces go, lowest first to those that stay
            assert enc.n <= 600
    assert (found < 10).all()
