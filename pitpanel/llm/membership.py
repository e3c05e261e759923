"""A bit filter of fixed size over 64-bit hashes, told apart by their leading bits: it may let strangers pass, but never withholds a member.

Its 8 MB do not grow with the number of members, so it can be broadcast; with very many members it only saves less.
Whoever uses it joins exactly afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def bit_filter(names: DataFrame) -> np.ndarray:
    """The filter of a one-column table of longs, built by aggregation; 2**(BITS - 6) rows at most reach the driver."""
    name = F.col(f"`{names.columns[0]}`")
    at = names.filter(name.isNotNull()).select(F.shiftrightunsigned(name, 64 - BITS).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.word.to_numpy(np.int64)] = words.bits.to_numpy(np.int64)
    return out.view(np.uint64)


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the names (uint64) may be members."""
    at = names >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
