"""Filters of fixed size over 64-bit keys: they let some other keys pass and lose none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Greatest number of bits of a filter, as a power of two (8 MB), and bits a key up to that size.
MOST_BITS, PER_KEY = 26, 5


def filter_of(keys: DataFrame, columns: list[str], most: int | None = None) -> np.ndarray:
    """Packed bits of the long `columns` of all rows; at most 2**most bits, whatever the number of rows."""
    most = MOST_BITS if most is None else most
    bits = int(min(most, max(16, np.ceil(np.log2(1 + keys.count() * len(columns))) + PER_KEY)))
    x = keys.select(F.explode(F.array(*[F.shiftrightunsigned(c, 64 - bits) for c in columns])).alias("x")).select((F.col("x") + 1).alias("x")).where("x is not null")
    pages = x.groupBy(F.bitmap_bucket_number("x").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()  # at most 2**most / 2**15
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in pages:
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    at = keys >> np.uint64(64 - (len(bitmap).bit_length() - 1) - 3)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
