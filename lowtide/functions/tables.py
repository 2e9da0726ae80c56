"""Fixed lookup tables. All have a fixed size, independent of the data, so they
may be broadcast."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Channel order of the named layouts.
CHANNEL_LAYOUTS = {
    "stereo": ("FL", "FR"),
    "2.1": ("FL", "FR", "LFE"),
    "3.0": ("FL", "FR", "FC"),
    "3.0(back)": ("FL", "FR", "BC"),
    "4.0": ("FL", "FR", "FC", "BC"),
    "quad": ("FL", "FR", "BL", "BR"),
    "quad(side)": ("FL", "FR", "SL", "SR"),
    "3.1": ("FL", "FR", "FC", "LFE"),
    "5.0": ("FL", "FR", "FC", "BL", "BR"),
    "5.0(side)": ("FL", "FR", "FC", "SL", "SR"),
    "4.1": ("FL", "FR", "FC", "LFE", "BC"),
    "5.1": ("FL", "FR", "FC", "LFE", "BL", "BR"),
    "5.1(side)": ("FL", "FR", "FC", "LFE", "SL", "SR"),
    "6.0": ("FL", "FR", "FC", "BC", "SL", "SR"),
    "6.0(front)": ("FL", "FR", "FLC", "FRC", "SL", "SR"),
    "hexagonal": ("FL", "FR", "FC", "BL", "BR", "BC"),
    "6.1": ("FL", "FR", "FC", "LFE", "BC", "SL", "SR"),
    "6.1(back)": ("FL", "FR", "FC", "LFE", "BL", "BR", "BC"),
    "6.1(front)": ("FL", "FR", "LFE", "FLC", "FRC", "SL", "SR"),
    "7.0": ("FL", "FR", "FC", "BL", "BR", "SL", "SR"),
    "7.0(front)": ("FL", "FR", "FC", "FLC", "FRC", "SL", "SR"),
    "7.1": ("FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"),
    "7.1(wide)": ("FL", "FR", "FC", "LFE", "BL", "BR", "FLC", "FRC"),
    "7.1(wide-side)": ("FL", "FR", "FC", "LFE", "FLC", "FRC", "SL", "SR"),
    "octagonal": ("FL", "FR", "FC", "BL", "BR", "BC", "SL", "SR"),
    "hexadecagonal": ("FL", "FR", "FC", "BL", "BR", "BC", "SL", "SR", "TFL", "TFC", "TFR", "TBL", "TBC", "TBR", "WL", "WR"),
    "downmix": ("DL", "DR"),
}

# Layout assumed for a channel count when the layout is unknown.
LAYOUT_BY_COUNT = {2: "stereo", 3: "2.1", 4: "3.1", 5: "4.1", 6: "5.1(side)", 8: "7.1"}

# Nominal third-octave centre frequencies, 10 Hz to 20 kHz.
NOMINAL_THIRD_OCTAVES = (
    10, 12.5, 16, 20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800,
    1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000,
)

# Attenuation in dB of mono mix and LFE re-mix inputs.
MONO_MAIN_DB, MONO_LFE_DB = -20.2, -10.2
REMIX_LFE_DB, REMIX_MAIN_DB = -10.0, -15.0

# Biquad slots and sample rate of the two device families.
DEVICE_SLOTS = {"hd": (10, 96000), "standard": (6, 48000)}

MAX_PASS_ORDER = 25


@lru_cache(maxsize=None)
def bessel_poles(order: int) -> tuple[complex, ...]:
    """Upper-half-plane poles of a Bessel low pass, scaled to unit asymptote.

    They are the roots of the reverse Bessel polynomial; the eigenvalue estimate
    is polished by Newton steps in extended precision.
    """
    coef = [
        math.factorial(2 * order - k) // (2 ** (order - k) * math.factorial(k) * math.factorial(order - k))
        for k in range(order + 1)
    ]
    unit = float(coef[0]) ** (1.0 / order)
    scaled = np.array([c * unit ** k / coef[0] for k, c in enumerate(coef)], dtype=np.longdouble)[::-1]
    slope = np.polyder(scaled)
    roots = np.roots(scaled.astype(float)).astype(np.clongdouble)
    for _ in range(50):
        roots = roots - np.polyval(scaled, roots) / np.polyval(slope, roots)
    upper = sorted((complex(r) for r in roots if r.imag > -1e-9), key=lambda r: abs(r.imag))
    return tuple(upper)


@lru_cache(maxsize=None)
def bessel_corner(order: int, drop_db: float) -> float:
    """Frequency at which the unit-asymptote Bessel low pass is ``drop_db`` down."""
    poles = [p for p in bessel_poles(order)]
    full = [q for p in poles for q in ((p, p.conjugate()) if abs(p.imag) > 1e-9 else (p,))]
    loss = lambda w: sum(20.0 * math.log10(abs(1j * w / p - 1.0)) for p in full) - drop_db
    low, high = 1e-3, 100.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if loss(mid) < 0 else (low, mid)
    return (low + high) / 2.0


# Loss at the corner frequency that defines each Bessel family.
BESSEL_DROP = {"BESP": None, "BESM3": 10.0 * math.log10(2.0), "BESM6": 6.0}



def bessel_rows() -> list[tuple[str, int, int, float, float]]:
    """(family, order, seq, q, f_mult); q is null for a one-pole section. Sections
    run from the real pole to the pair with the lowest Q last, highest first."""
    rows = []
    for family, drop in BESSEL_DROP.items():
        for order in range(1, MAX_PASS_ORDER + 1):
            scale = 1.0 if drop is None else bessel_corner(order, drop)
            poles = bessel_poles(order)
            single = [(None, abs(p) / scale) for p in poles if abs(p.imag) <= 1e-9]
            pairs = [(abs(p) / (-2.0 * p.real), abs(p) / scale) for p in poles if abs(p.imag) > 1e-9]
            for seq, (pole_q, mult) in enumerate(single + sorted(pairs, reverse=True)):
                rows.append((family, order, seq, pole_q, float(mult)))
    return rows


def bessel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bessel_rows(), "family string, order int, bseq int, bq double, bmult double")


def layout_table(spark: SparkSession) -> DataFrame:
    rows = [(name, c, ch) for name, chans in CHANNEL_LAYOUTS.items() for c, ch in enumerate(chans)]
    return spark.createDataFrame(rows, "layout string, channel_no int, channel string")
