"""What the operators of this subpackage share: words, local word ids, compact binary packing of
sorted integers, and keys that spread over partitions.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nearfield.sources.scratch import dropped, written

__all__ = ["Words", "dropped", "mix64", "pack_ints", "pack_sorted", "partitions", "prepare", "settle", "shards_for", "spread", "spread_keys", "unpack_ints", "unpack_sorted", "written"]

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def spread(df: DataFrame) -> DataFrame:
    """Deal rows anew where they come in fewer partitions than there are cores, as a small file
    with one row group does; inputs of any size worth a cluster stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # counting the partitions would run what is before the exchange
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input that one shard of an operator is made for.
SHARD_BYTES = 64 << 20


def shards_for(df: DataFrame, each: int = SHARD_BYTES) -> int:
    """Shards for an operator over ``df``: as many as shuffle partitions, and more where the files
    that ``df`` reads have more than ``each`` bytes for each of these."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # others say that they don't know
    return max(partitions(df.sparkSession), -(-known // each))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 -> bytes: gaps, byte planes, zstd.  High planes of the gaps vanish."""
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data), dtype=np.uint64)


def pack_ints(values: np.ndarray) -> bytes:
    import zstandard

    v = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(v).to_bytes(6, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_ints(data: bytes) -> np.ndarray:
    import zstandard

    n, width = int.from_bytes(data[:6], "little"), data[6]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[7:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.view(np.uint64).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def settle() -> None:
    """Give memory that is free back to the system: workers live as long as the session, and what
    one stage needed would stand against the next one's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The distinct words of a block of documents, in the order of their local ids."""

    def __init__(self, names: list[bytes]) -> None:
        self.names = names

    def hashes(self, seed: int = 0) -> np.ndarray:
        from xxhash import xxh3_64_intdigest as h

        return np.fromiter((h(w, seed) for w in self.names), dtype=np.uint64, count=len(self.names))


def spread_keys(n: int, partitions: int | None = None) -> list[int]:
    """``n`` integers of which Spark's hash partitioning sends the i-th to partition i of
    ``partitions`` (n or more): consecutive numbers would collide and leave partitions empty."""
    total = partitions or n
    if total < n:
        raise ValueError("there are fewer partitions than keys")
    found: dict[int, int] = {}
    missing, k = n, 0
    while missing:
        at = _spark_hash(k) % total
        if at < n and at not in found:
            found[at] = k
            missing -= 1
        k += 1
    return [found[i] for i in range(n)]


def _spark_hash(value: int) -> int:
    """Murmur3 of one 32-bit integer with seed 42, signed: what HASH partitioning divides."""
    mask = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & mask
    k = (k << 15 | k >> 17) & mask
    k = k * 0x1B873593 & mask
    h = 42 ^ k
    h = (h << 13 | h >> 19) & mask
    h = (h * 5 + 0xE6546B64) & mask
    h ^= 4
    h ^= h >> 16
    h = h * 0x85EBCA6B & mask
    h ^= h >> 13
    h = h * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h
