"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends at a blank where
the hash of the 16 bytes before it is divisible by ``CUTS``, so an insertion
moves only the ends next to it. Chunks are known by a 128-bit digest. The
first holder of a digest (the least id, and there the first place) keeps it;
elsewhere the chunk is a copy, and runs of copies of ``min_run`` bytes or more
are removed; a shorter run, as chance makes them, stays. Counts per digest are combined before they are shuffled, and the
join back to holders splits hot digests (AQE), so a passage that a third of all
documents share is never gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import BLANK, Texts, chunks, tidy
from ._util import Scratch, need

#: Bytes under the rolling hash; a chunk has at least MIN and at most MAX bytes.
WINDOW, MIN, MAX = 16, 24, 1024
#: One in CUTS blanks ends a chunk, and one in RARE_CUTS other characters (texts without blanks).
CUTS, RARE_CUTS = 4, 512
#: Bytes of a run of copies from which it is removed: about 13 words.
MIN_RUN = 80
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[buf[i - j]] << j over the WINDOW bytes up to i, by doubling."""
    h = _GEAR[buf]
    step = 1
    while step < WINDOW:
        moved = h.copy()
        moved[step:] += h[:-step] << np.uint32(step)
        h, step = moved, 2 * step
    return h


def cut(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all chunks, and for each text the number of chunks before it."""
    # the lowest bits see only the last bytes, so the high half decides
    h = (gear(t.buf) * np.uint32(0x9E3779B1)) >> np.uint32(8)
    blank = BLANK[t.buf]
    whole = np.ones(len(t.buf), bool)  # the byte ends a character
    whole[:-1] = (t.buf[1:] & 0xC0) != 0x80
    able = np.flatnonzero((blank & (h % np.uint32(CUTS) == 0)) | (~blank & whole & (h % np.uint32(RARE_CUTS) == 0))) + 1
    starts: list[int] = []
    at = [0]
    where = np.searchsorted(able, t.at).tolist()
    able = able.tolist()
    bounds = t.at.tolist()
    for i in range(t.n):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            starts.append(a)
            for c in able[where[i] : where[i + 1]]:
                while c - a > MAX:
                    a = _before(t.buf, a, a + MAX)
                    starts.append(a)
                if c - a >= MIN and c < b:
                    starts.append(c)
                    a = c
            while b - a > MAX:
                a = _before(t.buf, a, a + MAX)
                starts.append(a)
        at.append(len(starts))
    start = np.array(starts, np.int64)
    end = np.append(start[1:], len(t.buf)) if len(start) else start
    return start, end, np.array(at)


def _before(buf: np.ndarray, low: int, c: int) -> int:
    """The last start of a character at or before c."""
    k = c
    while k > low + MIN and buf[k] & 0xC0 == 0x80:
        k -= 1
    return k if k > low + MIN else c


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest of each text once: ``doc_id, d1, d2``."""
    for batch in batches:
        for t in chunks(batch["text"]):
            start, end, at = cut(t)
            d1, d2 = t.prints(start, end), t.prints(start, end, 1)
            doc = np.repeat(np.arange(t.n), np.diff(at))
            order = np.lexsort((d2, d1, doc))
            doc, d1, d2 = doc[order], d1[order], d2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            ids = batch["doc_id"].take(pa.array(t.first + doc[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(d1[new].view(np.int64)), pa.array(d2[new].view(np.int64))], names=["doc_id", "d1", "d2"])


def _strip(t: Texts, copies: list[list[dict] | None], min_run: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """For each text: chunks, copies removed, bytes and spans removed, and what is left."""
    start, end, at = cut(t)
    d1, d2 = t.prints(start, end).view(np.int64), t.prints(start, end, 1).view(np.int64)
    for i in range(t.n):
        a, b = at[i], at[i + 1]
        keys = list(zip(d1[a:b].tolist(), d2[a:b].tolist(), strict=True))
        elsewhere = {(c["d1"], c["d2"]) for c in copies[i] or ()}
        seen: set[tuple[int, int]] = set()
        kept, n_copies, removed, spans, run = [], 0, 0, 0, a
        low = int(t.at[i])
        for k in range(a, b + 1):
            copy = False
            if k < b:
                key = keys[k - a]
                copy = key in elsewhere or key in seen
                seen.add(key)
            if not copy:
                if k > run and end[k - 1] - start[run] >= min_run:
                    kept.append(t.buf[low : start[run]].tobytes())
                    removed += int(end[k - 1] - start[run])
                    n_copies += k - run
                    low, spans = int(end[k - 1]), spans + 1
                run = k + 1
        kept.append(t.buf[low : t.at[i + 1]].tobytes())
        yield b - a, n_copies, removed, spans, b"".join(kept)


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``df``: ``doc_id, text`` (what is left), ``n_bytes, n_chunks, n_copies, n_removed, n_spans, kept_sha256``.

    ``n_copies`` counts the chunks removed. Null texts count as empty; rows with
    a null id hold nothing for others and lose only what they repeat themselves;
    rows that repeat an id, with whatever texts, count as one document, whose
    chunks are no copies of each other. Very long texts are cut like any others
    and must fit in a task one at a time. An empty table gives no rows; other
    columns are ignored, but for those in ``carry``, which come back as the
    fields of a struct ``carried``.
    """
    need(df, id_col, text_col, *carry)
    s = Scratch(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    # without columns to carry the struct is a constant
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(True).alias("none")])
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
    rows = s.table(docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(_chunk_rows), f"doc_id {kind}, d1 long, d2 long"), "chunks")
    held = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).filter("holder < last")
    copies = rows.join(held.select("d1", "d2", "holder"), ["d1", "d2"]).filter("doc_id > holder").groupBy("doc_id").agg(F.collect_set(F.struct("d1", "d2")).alias("copies"))
    copies = s.table(copies, "copies")
    s.drop("chunks")
    marked = docs.join(copies, "doc_id", "left")
    fields = f"doc_id {kind}, text string, n_bytes long, n_chunks long, n_copies long, n_removed long, n_spans long, kept_sha256 string, carried {docs.schema['carried'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch["text"]):
                found = list(_strip(t, batch["copies"].slice(t.first, t.n).to_pylist(), min_run))
                n, c, r, s, left = zip(*found, strict=True)
                numbers = [pa.array(x, pa.int64()) for x in (np.diff(t.at), n, c, r, s)]
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in left])
                texts = pa.array([x.decode("utf-8", "replace") for x in left], pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(t.first, t.n), texts, *numbers, sha, batch["carried"].slice(t.first, t.n)], names=["doc_id", "text", "n_bytes", "n_chunks", "n_copies", "n_removed", "n_spans", "kept_sha256", "carried"])

    out = marked.mapInArrow(tidy(run), fields)
    return out if carry else out.drop("carried")
