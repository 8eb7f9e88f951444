"""The pipeline's stages on null and repeated ids: each row is judged for itself."""

import random

import pytest

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n=90):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [prose(rng) for _ in range(60)]


def run(spark, path, rows, stage, items=()):
    spark.createDataFrame(list(items) or [(0, "no such words in any text at all here")], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in rows], SCHEMA).repartition(3)
    out = dict(C.STAGES)[stage](spark, docs, str(path))
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_language(spark, tmp_path, texts):
    """A row without words takes no other row of its id with it."""
    rows = [*enumerate(texts), (5, ""), (None, texts[0] + " more"), (None, ""), (7, texts[7])]
    want = [*enumerate(texts), (None, texts[0] + " more"), (7, texts[7])]
    assert run(spark, tmp_path, rows, "language_id") == sorted(want, key=str)


def test_groups(spark, tmp_path, texts):
    """Texts of one id and of none are documents of their own; copies go."""
    near = texts[1] + " and"
    rows = [(1, texts[1]), (9, texts[2]), (9, near), (9, texts[3]), (9, texts[3]), (None, texts[4]), (None, texts[4]), (None, texts[5]), (4, texts[6])]
    out = run(spark, tmp_path, rows, "jaccard_join")
    assert len(out) == 6 and {t for _, t in out} - {near} - {texts[1]} == {texts[k] for k in (2, 3, 4, 5, 6)}
    assert sum(t in (texts[1], near) for _, t in out) == 1
    assert all(i is None for i, t in out if t in texts[4:6])


def test_chunks(spark, tmp_path, texts):
    """A passage is cut out of rows without an id too, and rows of one id aren't mixed up."""
    rows = [(1, texts[1]), (9, texts[2]), (9, texts[3]), (None, texts[4]), (None, texts[5] + " " + texts[4])]
    out = run(spark, tmp_path, rows, "substring_dedup")
    assert len(out) == 5 and {(1, texts[1]), (9, texts[2]), (9, texts[3])} <= set(out)
    assert sum(texts[4][100:-100] in t for i, t in out if i is None) == 1


def test_benchmark(spark, tmp_path, texts):
    """Only the row with the item goes, with or without an id."""
    item = " ".join(texts[3].split()[10:30])
    rows = [(1, texts[1]), (9, texts[2]), (9, texts[3]), (None, texts[4]), (None, texts[5] + " " + item)]
    assert run(spark, tmp_path, rows, "decontamination", [(1, item)]) == sorted([(1, texts[1]), (9, texts[2]), (None, texts[4])], key=str)
