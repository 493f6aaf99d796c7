"""Rounding as Python's ``round``: to the nearest decimal of the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1, splits a double into two halves whose products are exact


def _halves(x: Column) -> tuple[Column, Column]:
    t = F.lit(_SPLIT) * x
    hi = t - (t - x)
    return hi, x - hi


def py_round(x: Column, digits: int = 2) -> Column:
    """For moderate magnitudes (below 10^15 after scaling). The rounding error of x * 10^digits is computed
    exactly, so a product that only looks like a tie is not treated as one."""
    s = float(10**digits)

    def rounded(v: Column) -> Column:
        p = v * F.lit(s)
        vh, vl = _halves(v)
        sh, sl = _halves(F.lit(s))
        e = ((vh * sh - p) + vh * sl + vl * sh) + vl * sl
        r = F.floor(p).cast("double")
        f = p - r
        up = (f > 0.5) | ((f == 0.5) & (e > 0)) | ((f == 0.5) & (e == 0) & (r % 2 == 1))
        return F.when(up, r + 1).otherwise(r) / F.lit(s)

    one = F.transform(F.array(F.abs(x)), rounded)[0]
    return F.when(F.abs(x) < 1e12, F.when(x < 0, -one).otherwise(one)).otherwise(x)
