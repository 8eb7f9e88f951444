"""Removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else is removed. The strings are told apart as suffixes are in bucket-pointer
refinement: they begin in buckets of equal q-grams, and a bucket is refined by
sorting on the bucket identifiers of later offsets, whose own refinements are
reused, until equal identifiers mean ``LENGTH`` equal bytes. Strings alone in a
bucket drop out at once, which leaves little to refine:

1. The strings that start at consecutive places and have the same least q-gram
   (by fingerprint, q = ``GRAM``) form an item, filed in the bucket of that
   q-gram. Equal strings have the same least q-gram at the same offset, so all
   equal strings meet in one bucket. Buckets of one item hold no repeats.
2. Items of a bucket with equal contexts (the bytes under all their strings,
   and the offsets) are repeated throughout; only items with a context of their
   own, in a bucket of several, are refined. Both steps are counts by key with
   partial sums, so a passage in a third of all documents costs one row a task.
3. Distinct contexts of such buckets are refined together in numpy by
   ``equal_strings``. A bucket of more than ``PIECE`` contexts is refined in
   pieces; what is alone in its piece is compared across pieces by the bucket's
   and its own fingerprint.

A q-gram or a context of over one in ``HOT`` of the rows is one of fewer than
``HOT``, so these are broadcast and their rows stay where they are.

Text moves only to make contexts and to cut documents with repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import Texts, chunks, mix
from ._util import counted_join, need, table

LENGTH, GRAM = 200, 80
#: Distinct contexts of a bucket that are refined at once.
PIECE = 4096
#: Slots of the filter that keeps texts without repeats where they are.
SLOTS = 1 << 20
_POSITION = np.uint64(0xFFFFFFFF)


def items(t: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor (place of the least q-gram), first and last start of each item, and for each text the items before it."""
    n, none = len(t.buf), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(t.n + 1, np.int64)
    place = np.arange(n - gram + 1)
    least = (t.prints(place, place + gram) & ~_POSITION) | place.astype(np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    left = np.repeat(t.at[1:], np.diff(t.at))[: len(least)] - np.arange(len(least))
    start = np.flatnonzero(left >= length)
    if not len(start):
        return none, none, none, np.zeros(t.n + 1, np.int64)
    anchor = (least[start] & _POSITION).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(anchor) != 0)
    head = np.flatnonzero(new)
    low, high = start[head], start[np.append(head[1:], len(start)) - 1]
    return anchor[head], low, high, np.searchsorted(low, t.at)


def contexts(t: Texts, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Fingerprints of the bytes under an item's strings together with the offsets of its starts."""
    shape = (anchor - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)
    return t.prints(low, high + length, 1) ^ mix(shape)


def equal_strings(buf: np.ndarray, start: np.ndarray, length: int = LENGTH, first: int = 8) -> np.ndarray:
    """For each start the identifier of its string of ``length`` bytes: equal ones for equal strings.

    Buckets of equal ``first`` bytes are refined by the pair (own identifier,
    identifier at the offset reached); each round reuses the last one's
    identifiers and doubles the length they stand for. Only places in buckets of
    two or more are sorted again; the others keep identifiers of their own.
    """
    n = len(buf)
    word = np.zeros(n, np.uint64)
    for k in range(first):
        word[: n - k] |= buf[k:].astype(np.uint64) << np.uint64(8 * (first - 1 - k))
    _, ids = np.unique(word, return_inverse=True)
    ids = ids.astype(np.int64)
    reach = first
    while 2 * reach <= length:
        ids = _refined(ids, np.arange(n), reach)
        reach *= 2
    if reach < length:
        ids = _refined(ids, start, length - reach)
    return ids[start]


def _refined(ids: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers after sorting the places of shared buckets by the identifier ``offset`` later."""
    places = places[places + offset < len(ids)]
    active = places[np.bincount(ids, minlength=1)[ids[places]] > 1]
    out = ids.copy()
    if not len(active):
        return out
    top = int(ids.max()) + 1
    _, pair = np.unique(ids[active] * top + ids[active + offset], return_inverse=True)
    out[active] = top + pair
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``t, n, nth, gram, context`` of every item."""
    for batch in batches:
        for t in chunks(batch["text"]):
            anchor, low, high, at = items(t)
            own = pa.array(t.first + np.repeat(np.arange(t.n), np.diff(at)))
            nth = np.arange(len(anchor)) - np.repeat(at[:-1], np.diff(at))
            gram = t.prints(anchor, anchor + GRAM)
            yield pa.RecordBatch.from_arrays([batch["t"].take(own), batch["n"].take(own), pa.array(nth.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(contexts(t, anchor, low, high).view(np.int64))], names=["t", "n", "nth", "gram", "context"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for: ``gram, context, t, n, nth, single, pieces, bytes``."""
    for batch in batches:
        for t in chunks(batch["text"]):
            anchor, low, high, at = items(t)
            out: list[tuple] = []
            for i in range(t.n):
                for w in batch["wanted"][t.first + i].as_py():
                    k = at[i] + w["nth"]
                    out.append((w["gram"], w["context"], batch["t"][t.first + i].as_py(), batch["n"][t.first + i].as_py(), w["nth"], w["single"], w["pieces"], t.buf[low[k] : high[k] + LENGTH].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "context", "t", "n", "nth", "single", "pieces", "bytes"])


def _refine(bucket: pa.Table) -> pa.Table:
    """Rows ``t, n, nth, place, gram, print, piece``.

    A row without a print is a string found repeated. In buckets of several
    pieces, rows with a print are one for each class of strings of the piece:
    its item if the string is alone, else with a null item.
    """
    rows = bucket.select(["gram", "context", "t", "n", "nth", "single", "pieces", "piece", "bytes"]).to_pylist()
    rows = list({(r["gram"], r["context"]): r for r in sorted(rows, key=lambda r: (r["gram"], r["context"]))}.values())
    raw = b"".join(r["bytes"] for r in rows)
    size = np.array([len(r["bytes"]) for r in rows], np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    count = size - LENGTH + 1
    own = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start = before[own] + place
    buf = np.frombuffer(raw, np.uint8)
    # places of several buckets are refined side by side: equal strings lie in one bucket anyway
    _, ids, sizes = np.unique(equal_strings(buf, start), return_inverse=True, return_counts=True)
    repeated = sizes[ids] > 1
    single = np.array([r["single"] for r in rows])
    wide = np.array([r["pieces"] > 1 for r in rows])
    hit = np.flatnonzero(repeated & single[own])
    out: dict[str, list] = {k: [] for k in ("t", "n", "nth", "place", "gram", "print", "piece")}

    def add(which: np.ndarray, prints: list | None, named: np.ndarray | None = None) -> None:
        for j, k in enumerate(which.tolist()):
            r, known = rows[own[k]], named is None or bool(named[j])
            out["t"].append(r["t"] if known else None)
            out["n"].append(r["n"] if known else None)
            out["nth"].append(r["nth"] if known else None)
            out["place"].append(int(place[k]))
            out["gram"].append(r["gram"])
            out["print"].append(prints[j] if prints else None)
            out["piece"].append(r["piece"])

    add(hit, None)
    if wide.any():
        _, first = np.unique(ids, return_index=True)
        one = first[wide[own[first]]]
        t = Texts(buf, np.array([0, len(buf)]), 0)
        add(one, t.prints(start[one], start[one] + LENGTH, 1).view(np.int64).tolist(), ~repeated[one] & single[own[one]])
    kinds = {"t": pa.int64(), "n": pa.int64(), "nth": pa.int32(), "place": pa.int32(), "gram": pa.int64(), "print": pa.int64(), "piece": pa.int64()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in chunks(batch["text"]):
            anchor, low, high, at = items(t)
            change = np.zeros(len(t.buf) + 1, np.int64)
            for i, marks in enumerate(batch["marks"].slice(t.first, t.n).to_pylist()):
                for m in marks or ():
                    k = at[i] + m["nth"]
                    a, b = (low[k], high[k]) if m["place"] < 0 else (low[k] + m["place"],) * 2
                    change[a] += 1
                    change[b + LENGTH] -= 1
            gone = np.cumsum(change[:-1]) > 0
            removed = t.count(gone)
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edge = t.at[:-1][np.diff(t.at) > 0]
            head[edge] = gone[edge]
            left = [t.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
            columns = [batch["doc_id"].slice(t.first, t.n), pa.array(np.diff(t.at)), pa.array(removed), pa.array(t.count(head)), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left).

    Strings are judged on the input, matches never cross documents, and a place
    in the same text counts as elsewhere. Null texts count as empty; null ids
    and repeated rows are rows like any other (so a text given twice, of
    ``LENGTH`` bytes or more, is removed whole); very long texts are read
    whole, one at a time; an empty table gives no rows; other columns are ignored.
    """
    need(df, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a text is known by its 64-bit hash and its length
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n"))
    long = docs.filter(F.col("n") >= LENGTH).select("t", "n", "text")
    found = table(long.mapInArrow(_anchors, "t long, n long, nth int, gram long, context long"), "anchors")
    shared = found.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("context").alias("low"), F.max("context").alias("high")).filter("rows > 1").select("gram", "rows", (F.col("low") != F.col("high")).alias("mixed"))
    left = table(counted_join(found, table(shared, "grams"), ["gram"]), "shared")
    mixed = left.filter("mixed")
    alike = mixed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("t", "n", "nth")).alias("one"))
    alike = table(alike, "contexts")
    grams = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.min("rows").alias("least")).filter("least = 1")
    grams = table(grams.select("gram", F.col("contexts").alias("rows"), F.ceil(F.col("contexts") / PIECE).cast("long").alias("pieces")), "refinable")
    single = alike.select("gram", "context", (F.col("rows") == 1).alias("single"), "one.t", "one.n", "one.nth")
    asked = table(counted_join(single, grams, ["gram"]), "asked")
    total = asked.count()
    wanted = asked.groupBy("t", "n").agg(F.collect_list(F.struct("nth", "gram", "context", "single", "pieces")).alias("wanted"))
    # copies of a text give the same bytes: one goes on
    cut = _near(long, asked).dropDuplicates(["t", "n"]).join(wanted, ["t", "n"]).mapInArrow(_slices, "gram long, context long, t long, n long, nth int, single boolean, pieces long, bytes binary")
    piece = F.pmod("context", F.col("pieces"))
    placed = cut.withColumn("piece", piece).withColumn("bucket", F.pmod(F.xxhash64("gram", "piece"), F.lit(max(1, -(-2 * total // PIECE)))))
    refined = table(placed.groupBy("bucket").applyInArrow(_refine, "t long, n long, nth int, place int, gram long, print long, piece long"), "refined")
    across = refined.filter("print is not null")
    several = across.groupBy("gram", "print").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).filter("low < high").select("gram", "print")
    cols = ["t", "n", "nth", "place"]
    marks = refined.filter("print is null").select(cols).unionByName(across.filter("t is not null").join(several, ["gram", "print"]).select(cols))
    # whole items: all alike in their bucket, or one of several with the same context
    whole = left.filter("not mixed").select("t", "n", "nth").unionByName(counted_join(mixed, alike.filter("rows > 1").select("gram", "context", "rows"), ["gram", "context"]).select("t", "n", "nth"))
    marks = marks.unionByName(whole.withColumn("place", F.lit(-1)))
    marks = table(marks.groupBy("t", "n").agg(F.collect_set(F.struct("nth", "place")).alias("marks")), "marks")
    near, rest = _near(docs, marks), _near(docs, marks, False)
    kind = dict(df.dtypes)[id_col]
    cut = near.join(marks, ["t", "n"], "left").mapInArrow(_stripped, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("long")
    kept = F.col("text").cast("binary")
    return cut.unionByName(rest.select("doc_id", F.col("n").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept")))


def _near(texts: DataFrame, keys: DataFrame, within: bool = True) -> DataFrame:
    """The texts whose hash falls in a slot of a key's: all that are keys, and few others while keys are few.

    The filter has SLOTS rows at most, so it may be broadcast at any size.
    """
    slots = keys.select(F.pmod("t", F.lit(SLOTS)).alias("slot")).distinct()
    return texts.withColumn("slot", F.pmod("t", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi" if within else "left_anti").drop("slot")
