"""A set of hashes of bounded size, for leaving rows out before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, as a power of two: 8 MB.
SIEVE_BITS = 26


class Sieve:
    """A Bloom filter of 64-bit hashes with ``2**SIEVE_BITS`` bits, whatever it holds.

    It only spares rows the shuffle: what passes is joined exactly, so a full sieve costs time and no result. The bits
    are gathered by a grouped ``bit_or`` into ``2**(SIEVE_BITS - 6)`` numbers at most.
    """

    def __init__(self, hashes: DataFrame):
        self.width, self.mask = SIEVE_BITS, (1 << SIEVE_BITS) - 1
        h = F.col(hashes.columns[0])
        bit = F.explode(F.array(h.bitwiseAND(F.lit(self.mask)), F.shiftright(h, self.width).bitwiseAND(F.lit(self.mask)))).alias("bit")
        slots = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros(1 << self.width - 6, np.int64)
        self.bits[slots.column(0).to_numpy()] = slots.column(1).to_numpy()

    def passes(self, h: np.ndarray) -> np.ndarray:
        a, b = h & self.mask, h >> self.width & self.mask
        return ((self.bits[a >> 6] >> (a & 63)) & (self.bits[b >> 6] >> (b & 63)) & 1).astype(bool)
