"""A bitmap of the hashes of keys, which parts rows that cannot hold any of them from the others.

A join with a few keys out of many shuffles all rows of a wide table. With the bitmap in every
task most rows without a key are known before the shuffle, and only the others take part in the
join, which stays as exact as it is: rows are never told to hold a key, only to hold none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap has 2 to the power of this many bits, 4 MB, whatever the number of keys.
BITS = 25


def _place(columns: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def key_bits(keys: DataFrame, *columns: str) -> Broadcast:
    """The bitmap of all keys: 64 places make a word, and only the words reach the driver."""
    words = (
        keys.select(_place(columns).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (BITS - 6), dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def may_hold(bits: Broadcast, *columns: str) -> Column:
    """False for rows that hold none of the keys, true for all that hold one and for a few others."""

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array((bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return marked(_place(columns))
