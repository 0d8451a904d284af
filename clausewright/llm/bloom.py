"""A Bloom filter of bounded size, built in the cluster, that sifts what an exact join needs out of large tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.runtime import discard

BLOOM_BITS = 1 << 26


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), np.uint64, len(words))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(3) + right)


class Bloom:
    """A filter of 64-bit hashes of at most BLOOM_BITS bits; with more keys than it is made for it only lets more through."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        mask, out = np.uint64(len(self.words) * 64 - 1), np.ones(len(h), bool)
        for shift in (0, 21, 42):
            p = (h >> np.uint64(shift)) & mask
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def hashes_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(mix(word_hash(b.column("key").to_pylist())).view(np.int64))], names=["h"])


def hashes_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(pair_hash(word_hash(b.column("l").to_pylist()), word_hash(b.column("r").to_pylist())).view(np.int64))], names=["h"])


def bloom(hashes: DataFrame, most_bits: int = BLOOM_BITS) -> Bloom:
    """The filter of a column h, a materialized table that goes with it. Its bits are set in the cluster, and at most most_bits / 64 numbers
    are collected."""
    bits = 1 << 13
    n = hashes.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    at = F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(bits - 1)) for k in (0, 21, 42))))
    rows = hashes.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()
    discard(hashes)
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return Bloom(words.view(np.uint64))
