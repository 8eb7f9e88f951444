import math
import random
from collections import Counter

from pyspark.sql import functions as F

from fixlog.llm import language_id as L


def test_sample_is_identified(sample):
    rows = L.identify(sample).collect()
    assert len(rows) == sample.count() and {r.doc_id for r in rows} == {r.doc_id for r in sample.select("doc_id").collect()}
    assert sum(r.language == r.declared for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.97 * len(rows)


def test_held_out(spark):
    """Fitted to some rows, right on the others even where all is declared wrongly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 60")
    some, rest = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    mixed = some.unionByName(rest.withColumn("lang", F.lit(None).cast("string")))
    truth = {r.doc_id: r.lang for r in rest.collect()}
    got = [(r.text_language, truth[r.doc_id]) for r in L.identify(mixed).collect() if r.doc_id in truth]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)


def test_evidence_decides_short_texts(spark):
    """A text that could be either follows its declaration, or else its host."""
    en = ["the house and the garden with that thing over there number %d" % i for i in range(60)]
    de = ["das haus und der garten mit dem ding dort drüben nummer %d" % i for i in range(60)]
    rows = [(i, t, "en", "a.com") for i, t in enumerate(en)] + [(100 + i, t, "de", "b.de") for i, t in enumerate(de)]
    rows += [(900, "1234", "de", "c"), (901, "1234", None, "b.de"), (902, "1234", "en", "c"), (903, "1234", None, "a.com"), (904, "§§§§ ¤¤¤¤ ¶¶¶¶ ŧŧŧŧ", None, "a.com"), (905, None, "en", "a.com"), (906, "", None, None)]
    out = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [out[i].language for i in (900, 901, 902, 903, 904, 905, 906)] == ["de", "de", "en", "en", "und", "und", "und"]
    assert not out[904].accepted and not out[905].accepted and out[905].posterior == 0
    assert all(out[i].language == "en" for i in range(60)) and all(out[100 + i].language == "de" for i in range(60))


def test_priors_by_hand(spark):
    """The posterior of one document, from the formula."""
    rows = [(i, ("this is the text of it %d" if i % 3 else "dies ist der satz dazu %d") % i, "en" if i % 3 else "de", f"h{i % 2}", "com" if i % 2 else "net") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tld string")
    docs = df.select("doc_id", "text", F.col("lang").alias("declared"))
    known, logs = L.train(docs)
    assert known == ["de", "en", "und"] and logs.shape == (L.BUCKETS, 3)
    assert all(abs(float(math.fsum(math.exp(x) for x in logs[:, k].tolist())) - 1) < 1e-3 for k in range(3))
    out = {r.doc_id: r for r in L.identify(df, suffix_col="tld").collect()}
    text = {i: L_score(logs, t) for i, t, *_ in rows}
    best = {i: known[max(range(3), key=lambda k: s[k])] for i, s in text.items()}
    c = Counter((r[3], best[r[0]]) for r in rows)
    s = Counter((r[4], best[r[0]]) for r in rows)
    g = Counter(best.values())
    said = Counter((best[r[0]], r[2]) for r in rows)
    share = [(g[k] + 1) / 63 for k in known]
    share[2] = max(share[2], 0.01)
    for i, _, lang, host, tld in rows:
        above = [(s[tld, k] + 20 * share[j]) / (sum(s[tld, x] for x in known) + 20) for j, k in enumerate(known)]
        prior = [(c[host, k] + 20 * above[j]) / (sum(c[host, x] for x in known) + 20) for j, k in enumerate(known)]
        says = [(said[k, lang] + 0.5) / (sum(said[k, x] for x in ("de", "en")) + 0.5 * 4) for k in known]
        total = [text[i][j] + math.log(prior[j]) + math.log(says[j]) for j in range(3)]
        p = [math.exp(x - max(total)) for x in total]
        assert out[i].language == known[p.index(1.0)] and abs(out[i].posterior - 1 / sum(p)) < 1e-4


def L_score(logs, text):
    import pyarrow as pa

    from fixlog.llm._arrays import chunks

    (t,) = chunks(pa.array([text]))
    bucket, inside = L.trigrams(t)
    x = logs[bucket[inside]].astype(float).sum(0)
    return (x - x.max()) / L.TEMPER


def test_odd(odd, odd_rows, empty, spark):
    rows = L.identify(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.language == "und" for r in rows if r.doc_id in (0, 1))
    assert L.identify(empty).collect() == []
    none = spark.createDataFrame([(1, "words without any declaration", None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.language, r.accepted) for r in L.identify(none).collect()] == [("und", False)]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = L.identify_pages(pages).collect()
    assert len(rows) == pages.count() and sum(r.language == r.declared for r in rows) > 0.9 * len(rows)


def words_of(rng, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(12))


def test_rare_language(spark):
    """A language far below half a percent of the rows is recognised, declared or not, as it is in a corpus of its own."""
    rng = random.Random(3)
    common = [(i, words_of(rng, "etaoinsh"), "en", f"h{i % 7}") for i in range(9000)]
    rare = [(10000 + i, words_of(rng, "zqxkvwjy"), "xx", "rare.org") for i in range(30)]
    held = [(20000, words_of(rng, "zqxkvwjy"), None, "rare.org"), (20001, words_of(rng, "zqxkvwjy"), None, "h1")]
    schema = "doc_id long, text string, lang string, source string"
    for corpus in (rare + held, common + rare + held):
        out = {r.doc_id: r for r in L.identify(spark.createDataFrame(corpus, schema)).collect()}
        assert all(out[r[0]].language == "xx" and out[r[0]].accepted for r in rare + held)
    assert all(out[r[0]].language == "en" for r in common)


def test_many_languages(spark):
    """Sixty languages of equal and small parts: all are modelled, and plans stay small enough to run."""
    rng = random.Random(4)
    alphabet = [chr(0x430 + i) for i in range(32)] + list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(60):
        letters = rng.sample(alphabet, 9)
        rows += [(100 * k + i, words_of(rng, letters), f"l{k:02}", "h") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert L.train(docs.withColumnRenamed("lang", "declared"))[0] == [*(f"l{k:02}" for k in range(60)), "und"]
    out = L.identify(docs).collect()
    assert sum(r.language == r.declared and r.accepted for r in out) >= 0.98 * len(rows)


def test_suffix_of_host(spark):
    """A host seen once leans on its suffix; names without a dot have none."""
    hosts = spark.createDataFrame([("www.a.DE",), ("b.co.uk:8080",), ("c.fr.",), ("src7",), ("10.0.0.1",), ("",)], "h string")
    assert [r[0] for r in hosts.select(L.suffix_of(F.col("h"))).collect()] == ["de", "uk", "fr", "", "", ""]
    en = [(i, "the house and the garden with that thing over there number %d" % i, "en", f"e{i}.com") for i in range(60)]
    de = [(100 + i, "das haus und der garten mit dem ding dort drüben nummer %d" % i, "de", f"d{i}.de") for i in range(60)]
    english, german = "the house and garden with that thing over there".split(), "das haus und garten mit dem ding dort drüben".split()
    mixed = [" ".join(english[:a] + german[:b]) for a in range(2, 9) for b in range(2, 9)]
    new = [(1000 + 2 * k + j, t, ("de", "en")[k % 2], f"new{k}.{('de', 'com')[j]}") for k, t in enumerate(mixed) for j in (0, 1)]
    out = {r.doc_id: r for r in L.identify(spark.createDataFrame(en + de + new, "doc_id long, text string, lang string, source string")).collect()}
    pairs = Counter((out[1000 + 2 * k].language, out[1001 + 2 * k].language) for k in range(len(mixed)))
    assert pairs["de", "en"] > 0 and pairs["en", "de"] == 0
