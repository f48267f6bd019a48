"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, checksum, size). A keyed
Feistel network permutes the numbers below the next power of four, and cycle
walking (apply it again while the result is n or more) makes it a permutation
of 0..n-1. Permuted number p goes to shard ``p mod shards`` at slot
``p div shards``: shard sizes differ by one row at most, slots have no gaps,
and either direction is computed without a lookup (``place`` and ``row_at``).

Defined results: a null text has no bytes and the checksum of the empty string;
null ids are numbered first; rows that tie in id, checksum and size are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.session import materialize, shuffle_partitions

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _half_bits(n: int) -> int:
    """Bits of each half, so that two halves number at least n values."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of x under a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _scramble(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed % 2**64)]


def _network(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for k in keys:
        left, right = right, left ^ (_scramble(right, k) & mask)
    return (right << shift) | left  # halves swapped, so that the reversed keys undo it


def permute(rows: np.ndarray, n: int, seed: int, backward: bool = False) -> np.ndarray:
    """Where the permutation of 0..n-1 sends each row number, or where it came from."""
    keys = _keys(seed)[::-1] if backward else _keys(seed)
    bits = _half_bits(n)
    with np.errstate(over="ignore"):
        x = _network(np.asarray(rows, dtype=np.uint64), bits, keys)
        while (out := np.flatnonzero(x >= np.uint64(n))).size:
            x[out] = _network(x[out], bits, keys)
    return x.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each global row number."""
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Global row number that lies at each shard and slot."""
    return permute(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64), n, seed, backward=True)


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``row_number`` long, 0..n-1 in the given order, and n.

    The rows are range-partitioned and sorted once and that order is
    checkpointed; the offsets of the partitions (one row per partition) are
    then joined on. No partition sees more than its own range.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int").alias("__part")
    counts = sorted(ordered.groupBy(part).count().collect())  # one row per partition
    offsets, n = [], 0
    for p, c in counts:
        offsets.append((p, n))
        n += c
    table = F.broadcast(spark.createDataFrame(offsets, "__part int, __offset long"))
    out = ordered.withColumn("__part", part).join(table, "__part")
    return out.withColumn("row_number", F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__offset"), n


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(narrow, "doc_id", "text_crc32", "size")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shard, slot = place(rows.row_number.to_numpy(), n, shards, seed)
            yield rows.assign(shard=shard.astype(np.int32), slot=slot)

    return numbered.mapInPandas(assign, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole documents as one folder of Parquet per shard, in slot order.

    Documents meet their places by (id, checksum, size); each shard is spread
    over as many files as the shuffle gives, each sorted by slot.
    """
    places = shard_rows(docs, shards, seed, id_col, text_col).withColumn("__k", F.row_number().over(_ties("doc_id", "text_crc32", "size")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__crc": F.crc32(text.cast("binary")), "__size": F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")})
    keyed = keyed.withColumn("__n", F.row_number().over(_ties("__id", "__crc", "__size")))
    on = keyed["__id"].eqNullSafe(places["doc_id"]) & (keyed["__crc"] == places["text_crc32"]) & (keyed["__size"] == places["size"]) & (keyed["__n"] == places["__k"])
    joined = keyed.join(places.select("doc_id", "text_crc32", "size", "__k", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), on)
    joined = joined.select(*(keyed[c] for c in docs.columns), "__shard", "__slot")
    joined.repartition("__shard", F.floor(F.col("__slot") / 100_000)).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)


def _ties(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.lit(0))
