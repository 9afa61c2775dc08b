"""Reproducible global shuffle and sharding: a Feistel permutation of row numbers.

Row numbers 0 .. n-1 follow the order of the sort columns. A balanced Feistel network
permutes the smallest even-bit domain that holds n; a value outside 0 .. n-1 is permuted again
until it falls inside (cycle walking), which makes a permutation of 0 .. n-1. The permuted
number modulo the shards is the shard, its quotient the slot, so both can be computed from a
row number, and inverted, without any table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.store import keep

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)


def _mix(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (half + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & mask


def permuted(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The images of ``numbers`` (each in 0 .. n-1) under the permutation of 0 .. n-1."""
    bits = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = _keys(seed)
    value = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        left, right = value[todo] >> bits, value[todo] & mask
        for key in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _mix(left, key, mask), left
            else:
                left, right = right, left ^ _mix(right, key, mask)
        value[todo] = (left << bits) | right
        todo = todo[value[todo] >= n]
    return value.astype(np.int64)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number``, 0 .. n-1 in the order of the columns (nulls first); and n.

    Rows are range-partitioned and written with their place in their partition; the counts of
    the partitions give the offsets. Rows equal in every order column may swap numbers, so
    pass columns that tell different rows apart."""
    placed = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    placed = keep(placed.withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    # One row per partition of the range exchange, whose number is bounded by configuration.
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbers = placed.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_start") + F.col("_place"))
    return numbers.drop("_part", "_place", "_start"), before


def shuffled(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds row_number, shard and slot: shard counts differ by at most one, slots have no gap.

    An empty table stays empty; nulls sort first; equal rows each get a place of their own."""
    known, n = numbered(rows, order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            image = permuted(batch["row_number"].to_numpy(np.int64), n, seed)
            yield batch.assign(shard=(image % shards).astype(np.int32), slot=image // shards)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    nullable = [f.name for f in known.schema.fields if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return walk(b.astype({c: "Int64" for c in nullable if b[c].isna().any()}) for b in batches)

    return known.mapInPandas(typed, f"{schema}, shard int, slot long")


def sharded_documents(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every document; only sizes and checksums are
    sorted, never texts. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 1).alias("size"),
                        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    return shuffled(small, ["doc_id", "text_crc32", "size", "_hash"], shards, seed).drop("_hash")


def shard_of(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without any table."""
    image = int(permuted(np.array([row_number]), n, seed)[0])
    return image % shards, image // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies in a slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, inverse=True)[0])
