"""A bitmap of fixed size that spares most rows a join would drop anyway."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits, whatever the number of values; with more values than bits it spares no row, and nothing else changes.
FILTER_BITS = 1 << 24


def bitmap(values: DataFrame, column: str, bits: int = FILTER_BITS) -> Callable[[np.ndarray], np.ndarray]:
    """A function for workers: False where a 64-bit value is certainly not in ``column``.

    Values are taken modulo ``bits``, so they should be hashes.
    """
    bit = F.pmod(F.col(column), F.lit(bits)) + 1  # the bitmap functions count from 1
    parts = values.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for k, m in parts:
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(m)] = np.frombuffer(bytes(m), np.uint8)
    shared = values.sparkSession.sparkContext.broadcast(out.tobytes())

    def test(x: np.ndarray) -> np.ndarray:
        at = x.astype(np.int64) % bits
        return np.frombuffer(shared.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1

    return test
