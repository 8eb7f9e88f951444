"""Packing documents into training sequences: first-fit decreasing on a tournament tree.

Documents are tokenised in one pass that keeps only the measures of their
pieces: whole sequences, and the rest. Pieces are dealt at random (by hash)
into groups of about ``group_pieces``, and each group is packed on its own: by
falling length, each piece into the leftmost sequence that has room, found in
O(log n) by a tournament tree whose nodes hold the most room below them. Texts
are never shuffled, and a group's size doesn't follow the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import chunks, give_back
from ._bpe import encoder, with_end
from ._util import need, table

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
#: Bytes of text encoded at a time, and pieces that a worker keeps: both stand in its memory beside the tokenizer's tables.
PART, KEPT = 1 << 18, 600_000


class Rooms:
    """A tournament tree over the free room of ``n`` bins; the root holds the most."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes ``size`` from the leftmost bin that has it, and returns that bin."""
        most, node = self.most, 1
        if most[1] < size:
            raise ValueError(f"no bin has room for {size}")
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        most[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            a, b = most[2 * node], most[2 * node + 1]
            best = a if a > b else b
            if most[node] == best:
                break
            most[node] = best
        return found


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal sizes are taken in the order given."""
    order = np.argsort(-sizes, kind="stable")
    rooms = Rooms(len(sizes), room)
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: dict[int, int] = {}
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = rooms.first_fit(size)
        bins[k], offsets[k] = b, used.get(b, 0)
        used[b] = offsets[k] + size
    return bins, offsets


def pack(df: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 8192, seed: int = 7) -> DataFrame:
    """Packs every row of ``df`` into sequences of at most ``length`` tokens.

    A row's ids are its text's by the tokenizer file ``tokenizer`` and then
    ``end_id``. Returns one row per piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``. Null and empty texts make a piece of the
    end id alone; null ids and repeated rows are rows like any other; very long
    texts are cut into pieces of ``length`` ids; an empty table gives no rows;
    other columns are ignored.
    """
    need(df, id_col, text_col)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, KEPT)
        for batch in batches:
            give_back()
            for t in chunks(batch["text"], PART):
                ids, at = with_end(*enc.encode(t), end_id)
                whole = np.diff(at)
                count = -(-whole // length)
                doc = np.repeat(np.arange(t.n), count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * length
                size = np.minimum(length, whole[doc] - start)
                first = at[doc] + start
                crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(t.first + doc)), *map(pa.array, (start, size, crc, whole[doc]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = table(docs.mapInArrow(pieces, f"doc_id {kind}, {PIECE}"), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf["sequence_id"], pdf["offset"] = pdf["group"].to_numpy() * (1 << 32) + bins, offsets
        return pdf.drop(columns="group")

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(packed, f"doc_id {kind}, {PIECE}, sequence_id long, offset long")
