"""A filter of fixed size over 64-bit hashes: what it lets through is checked by a join, so its size bounds memory and never a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (4 MB). It is the same at every size of the data; more members let more through to the join.
BITS = 1 << 25
_BUCKET = 32768  # fixed value: bits of one bitmap of bitmap_construct_agg


def collect_bits(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter's bytes; at most bits / 32768 rows of 4 KB come to the driver."""
    place: Column = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    marked = hashes.where(F.col(column).isNotNull()).select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    width = _BUCKET // 8
    for r in marked.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        at = (r["bucket"] - 1) * width
        raw = np.frombuffer(bytes(r["map"]), np.uint8)[: len(out) - at]
        out[at : at + len(raw)] = raw
    return out


def passes(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes may be members."""
    place = hashes & np.uint64(len(filter_bytes) * 8 - 1)
    return (filter_bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
