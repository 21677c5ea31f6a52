"""Numeric column helpers. Each rounding convention has its own name."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(num(low), F.least(num(high), c))


def clamp01(c: Column) -> Column:
    """Clamp to 0..1; null and non-finite become null."""
    return F.when(is_finite(c), clamp(c, 0.0, 1.0))


def is_finite(c: Column) -> Column:
    """False for null, NaN (which sorts above every number) and infinities."""
    return F.coalesce(F.abs(c) <= sys.float_info.max, F.lit(False))


def finite_nonneg(c: Column) -> Column:
    return F.when(is_finite(c) & (c >= 0), c)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column, digits: int = 0) -> Column:
    """Bankers' rounding, as used by the batch side."""
    return F.bround(c, digits)


def half_up_int(c: Column) -> Column:
    """floor(x + .5), as used by the service side."""
    return F.floor(c + F.lit(0.5))


def asr_confidence(avg_logprob: Column, no_speech: Column) -> Column:
    return F.greatest(
        F.lit(0.05),
        F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), avg_logprob)) * (F.lit(1.0) - no_speech)),
    )
