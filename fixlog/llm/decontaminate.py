"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of the two
says little; what counts is the share of an item's word shingles that a
document contains. Documents are partitioned by the size of their shingle sets
(powers of two). A document of partition p is signed by one permutation in
2 ** (p + extra) bins, the least shingle of each; an item whose shingles hit
any bin minimum is a candidate. The bins of each partition grow with its sizes,
so the chance that a contained shingle is a minimum is the same in long and in
short documents, and ``extra`` is set from the smallest item so that the chance
of missing one is below ``miss``; where no finite number of bins does that
(items of very few shingles), all shingles are kept. Candidates are verified on
the exact sets. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import need, table, text_of

#: Rows up to which a table of ids is broadcast; beyond, joins are dealt by key.
SMALL = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingles(word_col: str, width: int) -> Column:
    """Sorted distinct fingerprints of the runs of ``width`` words; of fewer words, the whole sequence."""
    w = F.col(word_col)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    whole = F.array(F.xxhash64(F.lit(-1), w))
    return F.sort_array(F.array_distinct(F.when(F.size(w) >= width, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<long>"))))


def extra_bits(smallest: int, threshold: float, miss: float) -> int | None:
    """Bits beyond the partition's own, None for all shingles.

    At least k = ceil(threshold * smallest) shingles are contained; each is its
    bin's minimum with a chance of at least (1 - e^-x) / x at x = 2 ** (1 - bits).
    """
    k = math.ceil(threshold * smallest)
    for bits in range(5):
        x = 2.0 ** (1 - bits)
        if (1 - (1 - math.exp(-x)) / x) ** k <= miss:
            return bits
    return None


def signature(bits: int | None) -> Column:
    """The bin minima of the sorted ``set``; a fingerprint's bin is its leading ``bits`` (a column)."""
    s = F.col("set")
    if bits is None:
        return s
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, F.lit(64) - F.col("bits"))
    return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))


def contained(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, width: int = 5, miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs ``doc_id, item_id, n_item_shingles, n_shared, containment`` with containment >= ``threshold``.

    Rows that repeat a document or an item give one pair, with the largest
    share. Texts that are null, empty or without a word contain nothing and are
    contained in nothing; an item of fewer than ``width`` words is found only as
    the whole of an equally short text. Very long texts are whole sets like any
    others. Rows with a null id aren't reported.
    Empty tables give no rows; other columns are ignored.
    """
    need(docs, id_col, text_col)
    need(items, item_id, item_text)
    known = items.select(F.col(item_id).alias("item_id"), words(text_of(item_text)).alias("w")).select("item_id", shingles("w", width).alias("item_set"))
    known = table(known.filter("item_id is not null and size(item_set) > 0").distinct(), "items")
    sizes = known.agg(F.min(F.size("item_set")), F.sum(F.size("item_set"))).first()
    bits = extra_bits(sizes[0] or 1, threshold, miss)
    few = (sizes[1] or 0) <= SMALL
    index = known.select(F.explode("item_set").alias("h"), "item_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).filter("doc_id is not null")
    sets = texts.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingles("w", width).alias("set"))
    own = F.greatest(F.floor(F.log2(F.greatest(F.size("set"), F.lit(1)))).cast("int") + (bits or 0), F.lit(1))
    signed = sets.select("doc_id", "set", own.alias("bits")).select("doc_id", F.explode(signature(bits)).alias("h"))
    found = signed.join(F.broadcast(index) if few else index, "h").select("doc_id", "item_id").distinct()
    found = table(found, "candidates")
    some = found.select("doc_id").distinct()
    some = F.broadcast(some) if found.count() <= SMALL else some
    held = texts.join(some, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingles("w", width).alias("set"))
    pairs = held.join(F.broadcast(found) if found.count() <= SMALL else found, "doc_id").join(F.broadcast(known) if few else known, "item_id")
    pairs = pairs.select("doc_id", "item_id", F.size("item_set").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("set", "item_set")).cast("long").alias("n_shared"))
    pairs = pairs.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6)).filter(F.col("n_shared") >= F.col("n_item_shingles") * F.lit(threshold) - 1e-9)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", "b.containment")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, with all their columns; null ids stay."""
    id_col = options.get("id_col", "doc_id")
    hit = table(contained(docs, items, **options).select(F.col("doc_id").alias(id_col)).distinct(), "hits")
    return docs.join(hit, id_col, "left_anti").select(*docs.columns)


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL for ``contained`` over ``documents`` and ``benchmark``."""
    cut = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    sets = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
    return f"""
    WITH d AS (SELECT doc_id, {cut} AS w FROM documents WHERE doc_id IS NOT NULL), i AS (SELECT item_id, {cut} AS w FROM benchmark),
    ds AS (SELECT doc_id, unnest({sets}) AS s FROM d), its AS (SELECT item_id, {sets} AS s FROM i),
    shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN (SELECT item_id, unnest(s) AS s FROM its) x USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, len(s)::BIGINT AS n_item_shingles, n_shared::BIGINT AS n_shared, round(n_shared / len(s), 6) AS containment
    FROM shared JOIN its USING (item_id) WHERE n_shared >= len(s) * {threshold} - 1e-9
    """
