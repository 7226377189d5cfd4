"""Seeded draws as column arithmetic: the ``n``-th draw of a seed has a closed form, so rows draw alike however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator's increment, shifts and odd constant.
STEP, SHIFTS, ODD = 0x6D2B79F5, (15, 7, 14), 61
_ALL = (1 << 32) - 1


def _low(x: Column) -> Column:
    """The lower 32 bits."""
    return x.bitwiseAND(F.lit(_ALL))


def _times(a: Column, b: Column) -> Column:
    """The lower 32 bits of a product of 32-bit numbers; halves of ``b`` keep it within 64 bits."""
    high = F.floor(b / F.lit(1 << 16)).cast("bigint")
    return _low(a * b.bitwiseAND(F.lit(0xFFFF)) + (a * high).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16))


def draw(seed: Column, n: Column) -> Column:
    """The ``n``-th draw (from 1) of ``seed`` in [0, 1), by 32-bit arithmetic on longs; negative seeds wrap."""
    state = _low(_low(seed.cast("bigint")) + _times(_low(n.cast("bigint")), F.lit(STEP)))
    one, two, three = SHIFTS
    right = lambda x, by: F.shiftright(x, by)
    t = _times(state.bitwiseXOR(right(state, one)), state.bitwiseOR(F.lit(1)))
    t = _low(t + _times(t.bitwiseXOR(right(t, two)), t.bitwiseOR(F.lit(ODD)))).bitwiseXOR(t)
    return t.bitwiseXOR(right(t, three)) / float(1 << 32)
