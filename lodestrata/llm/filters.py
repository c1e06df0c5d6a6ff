"""A filter of 64-bit hashes for Python workers, sized by the number of hashes up to a fixed bound.

It has BITS_PER_HASH bits for each hash, MOST_BITS at most, and tests PROBES of them; what it lets pass wrongly is more the
fuller it is, so whatever passes is joined exactly afterwards. The bits are put together by a grouped ``bit_or``: the driver
gets MOST_BITS / 64 numbers at most, whatever the number of hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
#: Right shifts of a hash whose low bits are its places.
PROBES = (0, 18, 36)


@dataclass
class HashFilter:
    bits: np.ndarray
    size: int

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """For each 64-bit hash (uint64) whether it may be one of those."""
        out = None
        for shift in PROBES:
            place = ((hashes >> np.uint64(shift)) & np.uint64(self.size - 1)).astype(np.int64)
            bit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            out = bit if out is None else out & bit
        return out.astype(bool)


def hash_filter(hashes: DataFrame, column: str = "hash", bits_per_hash: int = BITS_PER_HASH) -> HashFilter:
    """Of the column's 64-bit values; the frame is read twice."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (bits_per_hash * max(1, hashes.count()) - 1).bit_length()))
    places = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(size - 1).cast("long")) for s in PROBES)))
    each = hashes.select(places.alias("place"))
    words = each.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    packed = np.zeros(size // 64, np.uint64)
    packed[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return HashFilter(packed.view(np.uint8), size)
