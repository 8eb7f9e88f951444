"""Token files: frequency-ranked ids in a byte-aligned variable-length coding.

Ids are ranked by falling frequency, counted over all documents, in one table
beside the files. A file is a series of blocks in ascending order of
``doc_id``; each id is stored as its rank in one to four bytes, whose lengths
stand apart in control bytes of four two-bit codes. A reader finds all lengths
by one numpy lookup in a table of the 256 control bytes, and all values by a
gather.

Texts are encoded once, where they are read, to a scratch table of ids, as
ranks are known only when all ids have been counted. The ids, in two bytes each
where they allow it, are then dealt by ranges of ``doc_id`` to the files; rows of
one id by their ids and their places, so that a hot id fills many files. Files
go through Spark's own writer and commit protocol (one block per record, ended
by a newline), so they can be in any store that Spark knows.

    ranks: Parquet, rank long, id long, n long
    block: magic 4s, part u32, block u32, documents u32, ids u64, data u64
           null flag u8 and doc_id i64 of each document, ids of each u64
           control bytes, data bytes
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import chunks
from ._bpe import encoder, with_end
from ._util import Scratch, cleaned_up, need, scratch_path, table, text_of

MAGIC = b"FXT2"
HEAD = struct.Struct("<4sIIIQQ")
#: Ids that a writer gathers before it ends a block.
BLOCK_IDS = 1 << 21
#: Bytes of text for each file, at which a reader's memory is a few times as much.
FILE_BYTES = 16 << 20
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a series of numbers below 2 ** 32."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        some = size > k if k else slice(None)
        data[at[some] + k] = (ranks[some] >> (8 * k)) & 0xFF
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers again: lengths by table lookup, values by a gather."""
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    value = data[at].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        value[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def write_block(part: int, block: int, doc_ids: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, part, block, len(doc_ids), len(ranks), len(data))
    return b"".join([head, null.tobytes(), keys.tobytes(), sizes.astype("<u8").tobytes(), control, data])


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """Part, block, doc ids, sizes and ranks of each block of a file."""
    at = 0
    while at < len(content):
        magic, part, block, docs, n, size = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        null, keys, sizes = take("u1", docs), take("<i8", docs), take("<u8", docs)
        ranks = decode_ranks(take("u1", -(-n // 4)), take("u1", size), n)
        at += 1  # the newline that ends a record
        yield part, block, [None if x else int(k) for x, k in zip(null, keys, strict=True)], sizes.astype(np.int64), ranks


def _ids(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for t in chunks(batch["text"]):
                flat, at = with_end(*enc.encode(t), end_id)
                if flat.max() < 1 << 16:
                    flat = flat.astype("<u2")
                raw = pa.Array.from_buffers(pa.large_binary(), t.n, [None, pa.py_buffer(at * flat.itemsize), pa.py_buffer(flat)])
                places = np.arange(place, place + t.n) + part
                place += t.n
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(t.first, t.n), raw.cast(pa.binary()), pa.array(np.diff(at)), pa.array(np.diff(t.at)), pa.array(places)], names=["doc_id", "ids", "n", "bytes", "place"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Rows' keys and ids, in groups of ``least`` ids or, where a row is longer, one more row."""
    keys: list[int | None] = []
    ids: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for key, n, raw in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
            content = raw.as_buffer()
            keys.append(key)
            ids.append(np.frombuffer(content, f"<u{content.size // n}"))
            size += n
            if size >= least:
                yield keys, ids
                keys, ids, size = [], [], 0
    if keys:
        yield keys, ids


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in a task's rows."""
    sums = np.zeros(0, np.int64)
    for _, ids in _gathered(batches, BLOCK_IDS // 4):
        n = np.bincount(np.concatenate(ids), minlength=len(sums))
        n[: len(sums)] += sums
        sums = n
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["id", "n"])


def _blocks(rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for nth, (keys, ids) in enumerate(_gathered(batches, BLOCK_IDS)):
            raw = write_block(part, nth, keys, np.array([len(x) for x in ids]), rank_of[np.concatenate(ids)])
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

    return run


def write(df: DataFrame, path: str, tokenizer: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every text of ``df`` to files under ``path`` in ascending order of id.

    Null texts count as empty: the end id alone. Null ids come first; rows that
    repeat an id stand next to each other, if need be in several files. A very
    long text is one document of one block. An empty table gives files without
    blocks. Other columns are ignored. The ranks are one number for each id of
    the vocabulary, and go to the tasks that way.
    """
    need(df, id_col, text_col)
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    encoded = scratch.table(docs.mapInArrow(_ids(tokenizer, end_id), "doc_id long, ids binary, n long, bytes long, place long"), "ids")

    counted = encoded.select("doc_id", "n", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    id_of, n = counted["id"].to_numpy(), counted["n"].to_numpy()
    by_rank = np.lexsort((id_of, -n))
    rank_of = np.zeros(id_of.max(initial=-1) + 1, np.uint32)
    rank_of[id_of[by_rank]] = np.arange(len(by_rank))
    ranks = pa.table({"rank": np.arange(len(by_rank)), "id": id_of[by_rank], "n": n[by_rank]})
    spark.createDataFrame(ranks).coalesce(1).write.parquet(f"{path}/ranks")

    files = max(1, -(-(encoded.agg(F.sum("bytes")).first()[0] or 0) // file_bytes))
    order = ["doc_id", F.xxhash64("ids"), "place"]
    dealt = encoded.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    with cleaned_up(spark):
        # the text writer puts bytes as they are, and a newline after each record
        dealt.mapInArrow(_blocks(rank_of), "value binary").select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(f"{path}/blocks")
    scratch.drop("ids")


def read(spark, path: str) -> DataFrame:
    """From the files under ``path``: ``doc_id, start, n_tokens, ids_crc32, part``, one row per document."""
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").toArrow()
    by_rank = np.zeros(ranks.num_rows, "<u4")
    by_rank[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                before = 0
                for part, _, keys, sizes, ranks in sorted(read_blocks(content.as_buffer()), key=lambda b: b[1]):
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    raw = by_rank[ranks]
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(before + at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])
                    before += int(at[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").select("content")
    rows = table(files.mapInArrow(documents, "part long, doc_id long, before long, n_tokens long, ids_crc32 long"), "token-index")
    # one row for each file
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part")


def round_trip(df: DataFrame, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes the files (to the shared folder unless ``path`` is given) and reads them back."""
    path = path or scratch_path(df.sparkSession, "tokens")
    write(df, path, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    return read(df.sparkSession, path)
