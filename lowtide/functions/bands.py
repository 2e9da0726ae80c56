"""Fractional-octave bands as column expressions (base-ten octave ratio)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lowtide.functions.tables import NOMINAL_THIRD_OCTAVES

# Fixed values of the band standard.
OCTAVE_RATIO = 10.0 ** 0.3
BAND_REFERENCE_HZ = 1000.0


def _position(f: Column, fraction: Column) -> Column:
    return fraction * F.ln(f / BAND_REFERENCE_HZ) / math.log(OCTAVE_RATIO)


def _odd(fraction: Column) -> Column:
    return fraction % 2 == 1


def centre(n: Column, fraction: Column) -> Column:
    power = F.when(_odd(fraction), n / fraction).otherwise((n * 2.0 + 1.0) / (fraction * 2.0))
    return F.pow(F.lit(OCTAVE_RATIO), power) * BAND_REFERENCE_HZ


def lower(centre_hz: Column, fraction: Column) -> Column:
    return centre_hz * F.pow(F.lit(OCTAVE_RATIO), -0.5 / fraction)


def upper(centre_hz: Column, fraction: Column) -> Column:
    return centre_hz * F.pow(F.lit(OCTAVE_RATIO), 0.5 / fraction)


def index_of(f: Column, fraction: Column) -> Column:
    """Index of the band nearest to a frequency."""
    at = _position(f, fraction)
    half = F.bround(at * 2.0 - 1.0) / 2.0
    even = F.when(half < 0, F.ceil(half)).otherwise(F.floor(half))
    return F.when(_odd(fraction), F.bround(at)).otherwise(even).cast("int")


def holding(f: Column, fraction: Column) -> Column:
    """Index of the band with lower < f <= upper."""
    at = _position(f, fraction)
    return F.when(_odd(fraction), F.ceil(at - 0.5)).otherwise(F.ceil(at) - 1).cast("int")


def _significant(x: Column, digits: Column) -> Column:
    step = F.pow(F.lit(10.0), F.floor(F.log10(x)) - digits + 1)
    return F.round(F.round(x / step) * step, 9)


def nominal(n: Column, fraction: Column) -> Column:
    """Label of a band: the standard's table for 1/1 and 1/3 octaves (scaled by
    octaves or decades outside it), rounded centres for the others."""
    thirds = F.array(*[F.lit(float(v)) for v in NOMINAL_THIRD_OCTAVES])
    octaves = F.array(*[F.lit(float(v)) for v in NOMINAL_THIRD_OCTAVES[2::3]])
    held = F.greatest(F.least(n, F.lit(4)), F.lit(-6))
    whole = F.element_at(octaves, (held + 7).cast("int")) * F.pow(F.lit(2.0), n - held)
    decades = F.when(n >= 14, F.floor((n - 14) / 10) + 1).when(n < -20, -(F.floor((-21 - n) / 10) + 1)).otherwise(F.lit(0))
    third = F.element_at(thirds, (n - decades * 10 + 21).cast("int")) * F.pow(F.lit(10.0), decades)
    x = centre(n, fraction)
    lead = F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x))))
    digits = F.when((fraction == 2) | (lead < 5), 3).otherwise(2)
    return F.when(fraction == 1, whole).when(fraction == 3, third).otherwise(_significant(x, digits))
