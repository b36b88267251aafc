"""Sharding: a Feistel permutation over global row numbers.

Row numbers come from a fixed order of the rows (a hash bucket of the
document id, then id, size and checksum), so reruns and other partitionings
give the same numbers.  An unbalanced Feistel network on Z_a x Z_b, a * b >= n,
permutes them; numbers that land outside [0, n) walk the cycle until they are
inside.  At most a - 1 numbers lie outside, so the walk is written with that
many steps and is exact.  shard and slot are the remainder and quotient of the
position, thus computable from a row number alone.

Law ``rows``: shard sizes differ by one row at most; slots have no gap.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id sorts
first; rows equal in id, size and checksum are interchangeable and get
consecutive numbers; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import stored

#: rows that one bucket of the numbering should hold, and the least and most buckets
ROWS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 4096, 1 << 20
ROUNDS = 6
#: longest array that one row is exploded into at once
SPAN = 100_000


def _keys(seed: int) -> list[int]:
    digest = [hashlib.sha256(f"{seed}/{k}".encode()).digest() for k in range(ROUNDS)]
    return [int.from_bytes(d[:8], "big", signed=True) for d in digest]


def permute(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number x, 0 <= x < n, in a permutation of [0, n)."""
    if n <= 1:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v: Column) -> Column:
        right = F.pmod(v, F.lit(b))
        left = ((v - right) / F.lit(b)).cast("long")
        for k, key in enumerate(_keys(seed)):
            if k % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(key)), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(key)), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    outside = a * b - n
    first = once(x.cast("long"))
    if not outside:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(outside)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(walk)


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Global row numbers (``number``) in a fixed order, and the number of rows.

    Rows alike in all keys are counted first and dealt out again at the end,
    so no bucket depends on how often one row repeats.
    """
    counted = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "row-numbers")
    n = counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    buckets = min(max(LEAST_BUCKETS, 1 << (n // ROWS_A_BUCKET).bit_length()), MOST_BUCKETS)
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)))
    by_bucket = dealt.groupBy("bucket").agg(F.sum("copies").alias("held"))
    # one row a bucket: at most MOST_BUCKETS rows, small enough to order in one task and to broadcast
    offsets = by_bucket.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("offset"))
    within = Window.partitionBy("bucket").orderBy(*keys)
    placed = dealt.withColumn("before", F.sum("copies").over(within) - F.col("copies")).join(F.broadcast(offsets), "bucket")
    placed = placed.withColumn("first", F.col("offset") + F.col("before"))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.lit(SPAN)))))
    last = F.least(F.col("block") * SPAN + SPAN, F.col("copies")) - 1
    return blocks.select(*keys, F.explode(F.sequence(F.col("block") * SPAN, last)).alias("nth"), "first").select(*keys, (F.col("first") + F.col("nth")).alias("number")), n


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    numbers, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    placed = numbers.withColumn("position", permute(F.col("number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("position"), F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(n_shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
