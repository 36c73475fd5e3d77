"""Arithmetic Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_round(value: Column, digits: int) -> Column:
    """Round a non-negative double as IEEE half-even on its exact binary value.

    Spark's ``round`` works on the printed decimal, so 0.575 becomes 0.58
    although the stored double lies below the tie. Here the distance to the
    tie is computed without error by splitting the double into two halves.
    """
    return let(value.cast("double"), lambda x: round_known(x, digits))


def round_known(x: Column, digits: int) -> Column:
    """The same of a double that is a column already: no lambda, so Spark compiles it."""
    scale = 10**digits
    low = F.floor(x * float(scale))
    high_part = x.cast("float").cast("double")
    gap = (high_part * float(2 * scale) - (low * 2 + 1)) + (x - high_part) * float(2 * scale)
    up = (gap > 0) | ((gap == 0) & (low % 2 == 1))
    return (low + up.cast("long")).cast("double") / float(scale)


def round_column(value: Column, digits: int) -> Column:
    """:func:`exact_round` of a column that is computed already.

    A plain filter on the result would copy its terms; see ``keep_where``.
    """
    return round_known(value.cast("double"), digits)
