"""A Bloom filter of bounded size over 64-bit hashes, built by a distributed job: no member is missing, some others pass."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_MEMBER, PROBES, MOST_BITS = 64, 4, 27


def word_hash(word: str) -> int:
    """The same in every process."""
    data = word.encode("utf-8", "surrogatepass")
    return (crc32(data) << 32 | crc32(data[::-1], len(data))) & 0xFFFFFFFFFFFFFFFF


def probe(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th places of some hashes in a filter of 2 ** bits bits."""
    h = hashes.view(np.uint64)
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


class Bloom:
    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that pass."""
        at = np.arange(len(hashes))
        for k in range(PROBES):
            place = probe(hashes[at], self.bits, k)
            at = at[(self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at

    def __contains__(self, word: str) -> bool:
        h = word_hash(word)
        for k in range(PROBES):
            place = ((h & 0xFFFFFFFF) + k * ((h >> 32) | 1)) & ((1 << self.bits) - 1)
            if not int(self.table[place >> 6]) >> (place & 63) & 1:
                return False
        return True


def build(members: DataFrame, column: str, words: bool = False) -> Bloom:
    """The filter of a column of hashes, or of words. What comes to the driver is bounded by the filter's size."""
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1, BITS_A_MEMBER * members.count()))))))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.fromiter(map(word_hash, batch["x"]), np.uint64, len(batch)) if words else batch["x"].to_numpy(np.int64)
            at = np.concatenate([probe(hashes, bits, k) for k in range(PROBES)])
            yield pd.DataFrame({"at": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    table = np.zeros(1 << (bits - 6), np.uint64)
    held = members.select(F.col(column).alias("x")).where("x is not null").mapInPandas(emit, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    table[held["at"].to_numpy(np.int64)] = held["bit"].to_numpy(np.int64).view(np.uint64)
    return Bloom(table, bits)
