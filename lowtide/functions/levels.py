"""Level arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the dB scale used for spectra.
REFERENCE_LEVEL = 0.5 ** 0.5  # full-scale sine, rms
POWER_FLOOR = 1e-20
DYNAMIC_RANGE_DB = 80.0
SILENCE_DB = -120.0


def gain_ratio(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), _col(db) / 20.0)


def db_from_power(power: Column, ref: float = 1.0) -> Column:
    """Power to dB against the squared reference, limited below at the power floor."""
    ref_power = F.lit(max(POWER_FLOOR, ref * ref))
    return 10.0 * F.log10(F.greatest(F.lit(POWER_FLOOR), power)) - 10.0 * F.log10(ref_power)


def power_from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def amplitude_from_db(db: Column) -> Column:
    return F.sqrt(power_from_db(db))


def amplitude_db(v: Column, floor: float) -> Column:
    return 20.0 * F.log10(F.greatest(F.abs(v), F.lit(floor)))


def waveform_db(v: Column) -> Column:
    """Display level of a sample; an exact zero shows as -180 dB."""
    return 20.0 * F.log10(F.when(v == 0.0, 1e-9).otherwise(F.abs(v)))


def clip(v: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def rounded(v: Column, places: int = 6) -> Column:
    """Rounded for reports; adding zero turns -0.0 into 0.0."""
    return F.round(v, places) + F.lit(0.0)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
