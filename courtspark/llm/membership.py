"""Filters of bounded size that tell which keys may belong to a table, however large the table is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most bits of a filter (32 MB). A filter of more keys than fit lets more strangers
#: through; whoever uses it decides exactly afterwards.
PER_KEY, MOST = 16, 1 << 28


def membership(keys: DataFrame, column: str, most: int = MOST) -> np.ndarray:
    """Two bits for each of the 64-bit hashes in ``column``, set by a partial aggregate; null keys set none."""
    n = keys.count()
    bits = 64
    while bits < min(most, PER_KEY * n):
        bits *= 2
    h = F.col(column)
    at = keys.where(h.isNotNull()).select(F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    found = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the table of the filter; true for every key that is."""
    mask = np.uint64(64 * len(words) - 1)
    out = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out
