"""Bloom filters of fixed size over 64-bit hashes: they let strangers through, but no member out, however many there are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SHIFTS = 26, (0, 19, 38)
_U = np.uint64


def bloom(hashes: DataFrame):
    """A broadcast bit array (8 MB) of the longs in column h. Its words are gathered by aggregation."""
    at = F.explode(F.array(*(F.shiftrightunsigned("h", s).bitwiseAND((1 << BITS) - 1) for s in SHIFTS))).alias("at")
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = hashes.select(at).groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(one).alias("w")).toArrow()
    bits = np.zeros(1 << (BITS - 6), _U)
    bits[words.column("i").to_numpy()] = words.column("w").to_numpy().view(_U)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True for each hash that the filter may hold; the second look-up is for those that pass the first, and so on."""
    left = np.arange(len(h))
    for shift in SHIFTS:
        at = (h[left] >> _U(shift)) & _U((1 << BITS) - 1)
        left = left[(bits[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1]
    found = np.zeros(len(h), bool)
    found[left] = True
    return found


def passes(bits, h: Column) -> Column:
    """holds() of the broadcast filter as a column; of the rows only the hashes go to Python."""

    @F.arrow_udf("boolean")
    def told(h):
        return pa.array(holds(bits.value, h.to_numpy(zero_copy_only=False).view(_U)))

    return told(h)
