"""Language identification by fusing evidence in Bayes' rule.

For each language l the score of a document is

    log P(text | l) / TEMPER + log P(declared | l) + log P(l | host)

* The text's likelihood is that of its byte trigrams (lower-cased, digits
  folded) in 2 ** 16 buckets, under multinomials fitted to a bounded sample of
  rows with a declared language; TEMPER allows for trigrams that overlap.
  Besides the languages stands 'und', under which all trigrams are alike: what
  fits it best is in none of them.
* P(declared | l) is the confusion of the declared markup language with the
  language that the text alone gives, over all rows.
* P(l | host) is a Dirichlet-smoothed share of the host's rows, towards the
  share of its address suffix, which is smoothed towards that of the corpus.

Counts come from grouped aggregates with partial sums over all rows; hosts are
joined back with salted keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import Texts, chunks, tidy
from ._util import need, table

BUCKETS = 1 << 16
TEMPER = 6.0
#: Rows of each declared language from which the model is fitted, in expectation.
TRAIN_ROWS = 2000
#: A declared language is modelled from so many rows on, whatever its share of the corpus.
MIN_ROWS = 20
#: With fewer rows it is modelled if it has this share of them, as in small tables.
MIN_SHARE = 0.005
#: Rows' worth of the parent's share in a suffix's or a host's.
STRENGTH = 20.0
UNKNOWN = "und"
#: Prior share of documents in none of the languages.
UNKNOWN_SHARE = 0.01
SALTS = 32

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that ends at each byte, and which of them lie in one text."""
    b = _FOLD[t.buf]
    code = b.copy()
    code[1:] |= b[:-1] << np.uint32(8)
    code[2:] |= b[:-2] << np.uint32(16)
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(b), bool)
    for k in (0, 1):
        at = t.at[:-1] + k
        inside[at[at < len(b)]] = False
    return bucket, inside


def _counts(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["declared"].to_pylist()
            for t in chunks(batch["text"]):
                bucket, inside = trigrams(t)
                own = np.repeat([index[langs[t.first + i]] for i in range(t.n)], np.diff(t.at))
                # only what occurs: a dense table would grow with the number of languages
                pairs, n = np.unique((own * BUCKETS + bucket)[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (pairs // BUCKETS, pairs % BUCKETS, n)], names=["lang", "bucket", "n"])

    return run


def train(docs: DataFrame, rows: int = TRAIN_ROWS, min_share: float = MIN_SHARE, min_rows: int = MIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, 'und' last, and log-likelihoods by bucket and language.

    ``docs`` has ``doc_id, text, declared``. Every declared language with
    ``min_rows`` rows passes, however rare it is, and with fewer rows if they
    are ``min_share`` of all. The counts collected are one number per language
    and bucket.
    """
    shares = docs.filter("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 0
    found = sorted((r.declared, r.n) for r in shares.filter(F.col("n") >= min(min_rows, min_share * total)).collect())
    index = {lang: k for k, (lang, _) in enumerate(found)}
    logs = np.zeros((BUCKETS, len(index) + 1), np.float32)
    logs[:, -1] = -math.log(BUCKETS)
    if index:
        slots = 1 << 20
        limits = F.create_map(*[F.lit(x) for lang, n in found for x in (lang, int(math.ceil(slots * min(1.0, rows / n))))])
        limit = F.coalesce(F.try_element_at(limits, F.col("declared")), F.lit(0))
        sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(slots)) < limit).select("text", "declared")
        sums = np.zeros((len(index), BUCKETS))
        counted = sample.mapInArrow(tidy(_counts(index)), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        sums[counted["lang"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
        smooth = 0.02
        logs[:, :-1] = (np.log(sums + smooth) - np.log(sums.sum(1, keepdims=True) + smooth * BUCKETS)).T
    return [*index, UNKNOWN], logs


def _scored(logs: np.ndarray, known: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language = np.ascontiguousarray(logs.T)
        for batch in batches:
            for t in chunks(batch["text"]):
                bucket, inside = trigrams(t)
                score = np.zeros((t.n, logs.shape[1]))
                for k in range(logs.shape[1]):
                    sums = np.zeros(len(bucket) + 1)
                    np.cumsum(np.where(inside, by_language[k][bucket], 0), out=sums[1:])
                    score[:, k] = sums[t.at[1:]] - sums[t.at[:-1]]
                score = np.round((score - score.max(1, keepdims=True)) / TEMPER, 6)
                n = t.count(inside)
                best = [known[k] if m else UNKNOWN for k, m in zip(score.argmax(1).tolist(), n.tolist(), strict=True)]
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(score.ravel()), logs.shape[1]).cast(pa.list_(pa.float64()))
                rest = [batch[c].slice(t.first, t.n) for c in ("doc_id", "declared", "host", "suffix")]
                yield pa.RecordBatch.from_arrays([*rest, arrays, pa.array(best), pa.array(n)], names=["doc_id", "declared", "host", "suffix", "scores", "text_language", "n_trigrams"])

    return run


def suffix_of(host: Column) -> Column:
    """What follows a host's last dot, without a port; '' for names without a dot and for numbers."""
    return F.regexp_extract(F.lower(host), r"\.([a-z][a-z0-9-]*)\.?(?::\d+)?$", 1)


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str | Column = "text", declared_col: str | Column = "lang", host_col: str | Column = "source", suffix_col: str | Column | None = None, train_rows: int = TRAIN_ROWS, limit: float = 0.5) -> DataFrame:
    """One row per row of ``df``: ``doc_id, declared, text_language, language, posterior, accepted``.

    ``language`` has the greatest posterior (ties: the first by name, 'und'
    last). A document is accepted if that isn't 'und' and its posterior is at
    least ``limit``. A text of fewer than three bytes, an empty or a null one
    says nothing: it is 'und' and not accepted. Suffixes are those of the hosts
    unless ``suffix_col`` is given. Null declarations, hosts and suffixes are
    values of their own; without any declared language all is
    'und'. Languages are those of ``train``: all with MIN_ROWS declared rows, at
    any share of the corpus. Null ids and repeated rows are rows like any other; very long texts
    count whole, one at a time; an empty table gives no rows; other columns are ignored.
    """
    need(df, *[c for c in (id_col, text_col, declared_col, host_col, suffix_col) if isinstance(c, str)])
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    kind = dict(df.dtypes)[id_col]
    blank = lambda c: F.coalesce(as_col(c).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), blank(text_col).alias("text"), F.nullif(F.lower(F.trim(as_col(declared_col).cast("string"))), F.lit("")).alias("declared"), blank(host_col).alias("host"), (blank(suffix_col) if suffix_col is not None else suffix_of(blank(host_col))).alias("suffix"))
    known, logs = train(docs, train_rows)
    scored = table(docs.mapInArrow(tidy(_scored(logs, known)), f"doc_id {kind}, declared string, host string, suffix string, scores array<double>, text_language string, n_trigrams long"), "scores")

    index = {lang: k for k, lang in enumerate(known)}
    n = len(known)
    # confusion of declarations: known languages, any other, none
    said = F.when(F.col("declared").isNull(), F.lit("-")).when(F.col("declared").isin(known[:-1]), F.col("declared")).otherwise("?")
    scored = scored.withColumn("said", said)
    values = [*known[:-1], "?", "-"]
    seen = np.full((n, len(values)), 0.5)
    place = {v: k for k, v in enumerate(values)}
    for r in scored.groupBy("text_language", "said").count().collect():
        seen[index[r.text_language], place[r.said]] += r["count"]
    confusion = np.log(seen / seen.sum(1, keepdims=True))
    # one literal that Catalyst folds, so that plans don't grow with the square of the languages
    flat = F.split(F.lit(" ".join(repr(round(float(x), 9)) for x in confusion.T.ravel())), " ").cast("array<double>")
    says = F.slice(flat, ((F.array_position(F.array(*map(F.lit, values)), F.col("said")) - 1) * n + 1).cast("int"), n)

    names = F.array(*map(F.lit, known))
    counts = scored.groupBy("suffix", "host", "text_language").count()
    as_map = F.map_from_entries(F.collect_list(F.struct("text_language", "count")))
    hosts = counts.groupBy("suffix", "host").agg(as_map.alias("c"))
    suffixes = counts.groupBy("suffix", "text_language").agg(F.sum("count").alias("count")).groupBy("suffix").agg(as_map.alias("s"))
    whole = {r.text_language: r.n for r in counts.groupBy("text_language").agg(F.sum("count").alias("n")).collect()}
    total = sum(whole.values())
    share = [(whole.get(lang, 0) + 1.0) / (total + n) for lang in known]
    share[-1] = max(share[-1], UNKNOWN_SHARE) if n > 1 else 1.0

    def smoothed(own: str, parent: Column) -> Column:
        among = F.aggregate(F.map_values(own), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.transform(names, lambda lang, k: (F.coalesce(F.try_element_at(F.col(own), lang), F.lit(0)) + STRENGTH * F.get(parent, k)) / (among + STRENGTH))

    above = suffixes.select("suffix", smoothed("s", F.array(*map(F.lit, share))).alias("p"))
    priors = hosts.join(above, "suffix").select("suffix", "host", F.transform(smoothed("c", F.col("p")), lambda x: F.log(x)).alias("prior"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_trigrams"), F.lit(SALTS)).cast("int")).join(priors, ["suffix", "host", "salt"])
    rows = rows.withColumn("fused", F.zip_with(F.zip_with("scores", says, lambda a, b: a + b), "prior", lambda a, b: F.round(a + b, 6)))
    rows = rows.withColumn("top", F.array_max("fused"))
    rows = rows.withColumn("posterior", F.when(F.col("n_trigrams") > 0, F.round(1 / F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))), 6)).otherwise(0.0))
    rows = rows.withColumn("language", F.when(F.col("n_trigrams") > 0, F.get(names, (F.array_position("fused", F.col("top")) - 1).cast("int"))).otherwise(UNKNOWN))
    return rows.select("doc_id", "declared", "text_language", "language", "posterior", ((F.col("language") != UNKNOWN) & (F.col("posterior") >= limit)).alias("accepted"))


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """``identify`` for raw pages (page_id, url, html): the markup's declaration, the host and its address suffix."""
    need(pages, "page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)
    return identify(pages, id_col="page_id", text_col=text, declared_col=declared, host_col=host, **options).withColumnRenamed("doc_id", "page_id")
