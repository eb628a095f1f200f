"""Two-decimal metric arithmetic.

Every mean and standard deviation is rounded to two places *before* it
is used again; lifts and z-scores are computed from those rounded values
and rounded once more. Rounding is HALF_UP on decimals (away from zero for
negatives), never banker's rounding.

A double aggregate goes to ``decimal(38,15)`` before rounding: Spark
casts a double through its shortest exact digits, so a mean that is
exactly 269.775 (stored as 269.77499999999997...) rounds to 269.78. A bare
``decimal`` cast would be ``decimal(10,0)`` and drop every fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,15)"
METRIC = "decimal(18,2)"


def round2(value: Column) -> Column:
    """Round a double or decimal expression to a ``decimal(18,2)``."""
    return F.round(value.cast(WIDE), 2).cast(METRIC)


def mean2(value: Column) -> Column:
    """``ROUND(AVG(x)::numeric, 2)``."""
    return round2(F.avg(value))


def stddev2(value: Column) -> Column:
    """``ROUND(STDDEV_POP(x)::numeric, 2)``: the population, not sample, deviation."""
    return round2(F.stddev_pop(value))


def weighted_mean2(value: Column, weight: Column) -> Column:
    """Mean of ``value`` repeated ``weight`` times, rounded like ``mean2``.

    Used where rows were pre-aggregated to (key, multiplicity) before a
    shuffle; for integer-valued inputs both sums are exact, so the result
    is the same double as ``avg`` over the expanded rows.
    """
    return round2(F.sum(value * weight).cast("double") / F.sum(weight).cast("double"))


def difference2(left: Column, right: Column) -> Column:
    """``ROUND(a - b, 2)`` of two already rounded metrics."""
    return F.round(left.cast(METRIC) - right.cast(METRIC), 2).cast(METRIC)


def ratio2(numerator: Column, denominator: Column) -> Column:
    """``ROUND(a / NULLIF(b, 0), 2)``: null when the rounded denominator is 0.00.

    ANSI mode raises on division by zero, so the NULLIF is required, not
    decoration (rule N2: a deviation below 0.005 rounds to 0 and gives null).
    """
    den = denominator.cast(METRIC)
    return F.round(numerator.cast(METRIC) / F.nullif(den, F.lit(0).cast(METRIC)), 2).cast(METRIC)


def percent2(part: Column, whole: Column) -> Column:
    """``ROUND(100.0 * part / whole, 2)`` in exact decimal arithmetic."""
    hundred = F.lit(100).cast("decimal(4,1)")
    return F.round(hundred * part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0)), 2).cast(METRIC)


def as_double(value: Column) -> Column:
    """Final metric columns leave as ``double`` so every engine compares equal."""
    return value.cast("double")
