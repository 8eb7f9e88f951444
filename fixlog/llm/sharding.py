"""Sharding by a minimax contiguous partition of ordered atomic groups.

Atomic groups are the buckets of a 64-bit hash of the text (its leading
``bucket_bits`` bits), so equal texts always stay together, and their order is
the order of the hash. The number of groups is a fixed parameter, 65,536, so
the vector of group sizes on which the capacity is searched has a proven bound
whatever the input holds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import need, table, text_of

#: A bucket with more rows than this, and than its fair share, is numbered in SALTS parts.
HOT_ROWS, SALTS = 50_000, 64


def fits(prefix: list[int], shards: int, capacity: int) -> bool:
    """Greedy check: can ``shards`` contiguous runs of at most ``capacity`` hold all groups?"""
    at, last = 0, len(prefix) - 1
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        if at == last:
            return True
    return at == last


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity under which the greedy check succeeds, by binary search."""
    if not sizes:
        return 0
    prefix = [0, *accumulate(sizes)]
    low = max(max(sizes), -(-prefix[-1] // shards))
    high = low + max(sizes)  # the mean and one group: always enough
    while low < high:
        middle = (low + high) // 2
        if fits(prefix, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """``shards - 1`` positions in the order of groups; shard k is [cut k-1, cut k).

    No shard exceeds the smallest capacity. Among the cuts that keep it, each is
    the one nearest to an even split, so the last shards aren't left short.
    """
    prefix = [0, *accumulate(sizes)]
    capacity, total, n = smallest_capacity(sizes, shards), prefix[-1], len(sizes)
    earliest = [n] * (shards + 1)  # from which the later shards can hold the rest
    for k in range(shards - 1, -1, -1):
        earliest[k] = bisect_left(prefix, prefix[earliest[k + 1]] - capacity)
    found, at = [], 0
    for k in range(1, shards):
        furthest = bisect_right(prefix, prefix[at] + capacity) - 1
        low, high = max(at, earliest[k]), furthest
        want = min(max(bisect_left(prefix, total * k / shards), low), high)
        if want > low and total * k / shards - prefix[want - 1] < prefix[want] - total * k / shards:
            want -= 1
        found.append(want)
        at = want
    return found


def shard_by_bytes(df: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, bucket_bits: int = 16) -> DataFrame:
    """Puts every row of ``df`` into one of ``shards`` shards of nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard``
    (null under this law). ``size`` is the text's UTF-8 bytes plus ``overhead``.
    Null texts count as empty; a null id is a row like any other; repeated rows
    each get a slot; a very long text can be a group above the even share, which
    then is the capacity; an empty table gives no rows. Other columns are ignored.
    """
    need(df, id_col, text_col)
    text = text_of(text_col)
    rows = table(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - bucket_bits).cast("int").alias("bucket"),
        ),
        "shards",
    )
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()  # 2 ** bucket_bits rows at most
    total = sum(r.n for r in sums)
    at = cuts([r.s for r in sums], shards)
    # a shard begins with the bucket at its cut; shards after the last bucket stay empty
    starts = [sums[c].bucket if c < len(sums) else 1 << bucket_bits for c in at]
    shard = sum((F.when(F.col("bucket") >= b, 1).otherwise(0) for b in starts), F.lit(0)).cast("int")
    hot = [r.bucket for r in sums if r.n > max(HOT_ROWS, total >> (bucket_bits - 1))]
    salt = F.when(F.col("bucket").isin(hot), F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)
    rows = rows.select("*", shard.alias("shard"), salt.alias("salt"))
    # at most 2 ** bucket_bits + 64 * 2 ** (bucket_bits - 1) rows, in practice the buckets and a few salts
    before = Window.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "salt").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.select("*", F.row_number().over(inside).alias("k"))
    return numbered.join(F.broadcast(parts), ["bucket", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
