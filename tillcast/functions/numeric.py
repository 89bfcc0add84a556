"""Guarded arithmetic (ANSI mode raises on x/0) and output rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is 0 or null (never raises under ANSI)."""
    return F.try_divide(col_(a), col_(b))


def r4(c: Column | str) -> Column:
    """Round a float output to 4 places, half up, with plain IEEE steps.

    Values are first snapped to 8 places, then ``floor(x * 1e4 + 0.5) / 1e4``.
    Both steps give the same bits in any engine for inputs that differ only in
    the last bits (sums taken in another order), including exact ties such as
    the mean of eight cent amounts; ``round`` breaks such ties differently
    across engines. Magnitudes >= 1e9 skip the snap (no long overflow).
    """
    x = col_(c)
    snapped = F.when(F.abs(x) < F.lit(1e9), F.floor(x * F.lit(1e8) + F.lit(0.5)) / F.lit(1e8)).otherwise(x)
    return (F.floor(snapped * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)).cast("double")


def snap8(c: Column | str) -> Column:
    """Round to 8 places first, so results that are exact ties at 4 places (and
    differ between engines only in the last bit) round the same way after r4."""
    return (F.floor(col_(c) * F.lit(1e8) + F.lit(0.5)) / F.lit(1e8)).cast("double")


def guarded_log1p(c: Column | str) -> Column:
    """log1p(x) where x > 0, else 1 (null included), as in the reference transform."""
    c = col_(c)
    return F.when(c > 0, F.log1p(c)).otherwise(F.lit(1.0))


def money(c: Column | str) -> Column:
    """Source money as an exact decimal, so sums agree across engines."""
    return col_(c).cast("decimal(18,2)")


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over the rows where both are present; null for constant input (no DIVIDE_BY_ZERO)."""
    x, y = col_(x), col_(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
