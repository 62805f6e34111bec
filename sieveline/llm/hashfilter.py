"""A Bloom filter over 64-bit hashes of a table, built by Spark and small enough to broadcast."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.textops import mix64

LEAST_LOG_BITS = 20


@dataclass
class HashFilter:
    """Two bits for each hash: its top bits, and those of its remix."""

    words: np.ndarray
    log_bits: int

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be in the table; all that are, pass."""
        out = np.ones(len(h), bool)
        for x in (h, mix64(h)):
            bit = (x >> np.uint64(64 - self.log_bits)).astype(np.int64)
            out &= (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def hash_filter(table: DataFrame, col: str, n: int, most_log_bits: int) -> HashFilter:
    """The filter of the ``n`` hashes in ``col`` (longs): 16 bits each, 2^``most_log_bits`` bits at most in all.

    About one foreign hash in 70 passes; beyond the bound more do. The words with a bit set, a row
    of 16 bytes each, are all that reaches the driver.
    """
    log_bits = max(6, min(most_log_bits, max(LEAST_LOG_BITS, math.ceil(math.log2(16 * n + 1)))))

    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            bit = np.unique(np.concatenate([x >> np.uint64(64 - log_bits) for x in (h, mix64(h))]).astype(np.int64))
            word, first = np.unique(bit >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first) if len(bit) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = table.select(col).mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(max(1, (1 << log_bits) >> 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return HashFilter(words, log_bits)
