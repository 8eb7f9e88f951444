"""Quality rules with a verdict for each host.

Each document is measured in numpy in one pass; the failures of each rule are
summed by host with partial aggregates, every host's rate is shrunk towards the
corpus by a beta prior fitted to the hosts' own rates (method of moments), and
the verdicts are joined back with salted keys, so a host that holds a third of
the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import BLANK, Texts, chunks, mix, owner
from ._util import need, table

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WEIGHT = np.random.default_rng(8).integers(0, 2**64, WINDOW, dtype=np.uint64) | np.uint64(1)
SALTS = 32
#: A host whose shrunk rate of a rule's failures is above this is turned away.
LIMIT = 0.6
#: Bounds of the weight of a prior, in documents.
WEIGHTS = (1.0, 10000.0)
RULES = ("short", "repeats", "symbols", "lines")


def measure(t: Texts) -> dict[str, np.ndarray]:
    """The measures of each text of a chunk."""
    start, end, at = t.words()
    n_words = np.diff(at)
    full = ~BLANK[t.buf]
    # lines with a word that equal an earlier one
    nl = np.flatnonzero(t.buf == 10)
    heads, tails = np.concatenate([t.at[:-1], nl + 1]), np.concatenate([t.at[1:], nl])
    heads.sort()
    tails.sort()
    own = np.repeat(np.arange(t.n), 1 + np.searchsorted(nl, t.at[1:]) - np.searchsorted(nl, t.at[:-1]))
    sums = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=sums[1:])
    some = sums[tails] > sums[heads]
    heads, tails, own = heads[some], tails[some], own[some]
    lines = np.bincount(own, minlength=t.n)
    key = mix(own.astype(np.uint64)) ^ t.prints(heads, tails)
    _, where = np.unique(key, return_index=True)
    dup_lines = lines - np.bincount(own[where], minlength=t.n)
    # words under windows that occur more than once in the text
    repeated = np.zeros(t.n, np.int64)
    n = len(start) - WINDOW + 1
    if n > 0:
        word = t.prints(start, end)
        win = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            win += word[j : j + n] * _WEIGHT[j]
        doc = owner(at)
        inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        key = mix(win[inside] ^ mix(doc[inside].astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = inside[order[twice]]
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
        repeated = np.bincount(doc[covered], minlength=t.n)
    return {
        "n_words": n_words,
        "word_chars": t.count(full & ((t.buf & 0xC0) != 0x80)),
        "n_symbols": t.count(_SYMBOL[t.buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [measure(t) for t in chunks(b["text"])]
        cols = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["host"], *cols], names=["doc_id", "host", *MEASURES])


def failures() -> dict[str, Column]:
    """Each rule as a condition that a failing document meets."""
    return {
        "short": F.col("n_words") < 20,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "symbols": F.col("n_symbols") * 10 > F.col("word_chars") * 3,
        "lines": F.col("n_dup_lines") * 100 > F.col("n_words") * 5,
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: ``host, n``, and for each rule its failures ``f_*`` and shrunk rate ``r_*``.

    The prior of a rule is Beta(a, b) with the mean m and variance v of the
    hosts' raw rates, weighted by their rows: a + b = m (1 - m) / v - 1, held
    within [1, 10000]; where all hosts agree (v = 0) it takes the upper end.
    The rate is (failures + a) / (n + a + b).
    """
    fails = failures()
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(fails[r].cast("long")).alias(f"f_{r}") for r in RULES])
    total = F.sum("n")
    moments = hosts.agg(*[x for r in RULES for x in ((F.sum(f"f_{r}") / total).alias(f"m_{r}"), (F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")) / total).alias(f"s_{r}"))]).first()
    rates = []
    for r in RULES:
        m = moments[f"m_{r}"] or 0.0
        v = max((moments[f"s_{r}"] or 0.0) - m * m, 0.0)
        weight = min(max(m * (1 - m) / v - 1 if v > 1e-12 else WEIGHTS[1], WEIGHTS[0]), WEIGHTS[1])
        rates.append(((F.col(f"f_{r}") + m * weight) / (F.col("n") + weight)).alias(f"r_{r}"))
    return hosts.select("host", "n", *[f"f_{r}" for r in RULES], *rates)


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, the five measures, ``base_failed``, ``kept``, ``host_rate``.

    A document is kept if it passes the base rules (at least 20 words, at most
    30 % of them in repeated windows of eight) and no rule's shrunk failure rate
    of its host exceeds ``limit``; ``host_rate`` is the largest of those rates.
    Null texts count as empty (no words: they fail), null hosts as the host '';
    repeated rows count and return each; very long texts count whole, one at a
    time; an empty table gives no rows; further columns are ignored.
    """
    need(df, id_col, text_col, host_col)
    fields = "doc_id {}, host string, {}".format(dict(df.dtypes)[id_col], ", ".join(f"{m} long" for m in MEASURES))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"))
    measured = table(docs.mapInArrow(_measured, fields), "measures")
    rate = F.greatest(*[F.col(f"r_{r}") for r in RULES])
    verdicts = host_rates(measured).select("host", rate.alias("host_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")).join(verdicts, ["host", "salt"])
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & (F.col("host_rate") <= limit)).alias("kept"), F.round("host_rate", 9).alias("host_rate"))


def oracle(limit: float = LIMIT) -> str:
    """DuckDB SQL for ``judge`` over ``documents``."""
    word = "[^\\x20\\x09-\\x0D]"
    tests = {"short": "n_words < 20", "repeats": "n_repeat_words * 100 > n_words * 30", "symbols": "n_symbols * 10 > word_chars * 3", "lines": "n_dup_lines * 100 > n_words * 5"}
    fails = ", ".join(f"count(*) FILTER ({t}) AS f_{r}" for r, t in tests.items())
    moments = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, greatest(sum(f_{r} * f_{r} / n) / sum(n) - (sum(f_{r}) / sum(n)) ** 2, 0) AS v_{r}" for r in tests)
    weights = ", ".join(f"least(greatest(CASE WHEN v_{r} > 1e-12 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {WEIGHTS[1]} END, {WEIGHTS[0]}), {WEIGHTS[1]}) AS w_{r}" for r in tests)
    rate = ", ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r})" for r in tests)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{word}+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS l FROM d),
    wins AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS s FROM w WHERE len(w) >= {WINDOW}),
    twice AS (SELECT r, i FROM wins JOIN (SELECT r, s FROM wins GROUP BY r, s HAVING count(*) > 1) USING (r, s)),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
    m AS (SELECT r, doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (r)),
    h AS (SELECT host, count(*) AS n, {fails} FROM m GROUP BY host), mo AS (SELECT {moments} FROM h), we AS (SELECT *, {weights} FROM mo),
    rates AS (SELECT host, greatest({rate}) AS host_rate FROM h, we)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND host_rate <= {limit} AS kept, round(host_rate, 9) AS host_rate
    FROM m JOIN rates USING (host)
    """
