"""Second-order sections as column expressions.

Every function maps parameter columns to one struct (b0, b1, b2, a1, a2) with
a0 = 1, so coefficients are computed inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BUTTERWORTH_Q = 0.5 ** 0.5
STEEPEST_SHELF_TERM = -1.9975  # 1/20^2 - 2: the slope limit is where Q reaches 20

KINDS = (
    "PeakingEQ", "LowShelf", "HighShelf", "LowPass1", "HighPass1",
    "LowPass2", "HighPass2", "AllPass", "Gain", "Passthrough", "LinkwitzTransform",
)


def section(b0: Column, b1: Column, b2: Column, a0: Column, a1: Column, a2: Column) -> Column:
    return F.struct(
        (b0 / a0).alias("b0"), (b1 / a0).alias("b1"), (b2 / a0).alias("b2"),
        (a1 / a0).alias("a1"), (a2 / a0).alias("a2"),
    )


def _angle(fs: Column, freq: Column) -> Column:
    return freq * F.lit(2.0 * math.pi) / fs


def peaking(fs: Column, freq: Column, q: Column, gain: Column) -> Column:
    w = _angle(fs, freq)
    alpha = F.sin(w) / (q * 2.0)
    amp = F.pow(F.lit(10.0), F.round(gain, 3) / 40.0)
    mid = F.cos(w) * -2.0
    return section(1.0 + alpha * amp, mid, 1.0 - alpha * amp, 1.0 + alpha / amp, mid, 1.0 - alpha / amp)


def _shelf(fs: Column, freq: Column, q: Column, amp: Column, side: float) -> Column:
    """Both shelves share one form; ``side`` is +1 for low, -1 for high."""
    w = _angle(fs, freq)
    tilt = F.cos(w) * side
    slope = F.sqrt(amp) * F.sin(w) / q
    up, down = amp + 1.0, amp - 1.0
    return section(
        amp * (up - down * tilt + slope),
        amp * (2.0 * side) * (down - up * tilt),
        amp * (up - down * tilt - slope),
        up + down * tilt + slope,
        (down + up * tilt) * (-2.0 * side),
        up + down * tilt - slope,
    )


def low_shelf(fs: Column, freq: Column, q: Column, gain: Column) -> Column:
    return _shelf(fs, freq, q, F.pow(F.lit(10.0), F.round(gain, 3) / 40.0), 1.0)


def high_shelf(fs: Column, freq: Column, q: Column, gain: Column) -> Column:
    return _shelf(fs, freq, q, F.pow(F.lit(10.0), gain / 40.0), -1.0)


def low_pass_1(fs: Column, freq: Column) -> Column:
    pole = F.exp(F.round(freq, 2) / fs * (-2.0 * math.pi))
    zero, one = F.lit(0.0), F.lit(1.0)
    return section(1.0 - pole, zero, zero, one, -pole, zero)


def high_pass_1(fs: Column, freq: Column) -> Column:
    t = F.tan(freq * math.pi / fs)
    zero, one = F.lit(0.0), F.lit(1.0)
    return section(one, -one, zero, t + 1.0, t - 1.0, zero)


def low_pass_2(fs: Column, freq: Column, q: Column) -> Column:
    w = _angle(fs, freq)
    alpha, open_ = F.sin(w) / (q * 2.0), 1.0 - F.cos(w)
    return section(open_ / 2.0, open_, open_ / 2.0, 1.0 + alpha, F.cos(w) * -2.0, 1.0 - alpha)


def high_pass_2(fs: Column, freq: Column, q: Column) -> Column:
    w = _angle(fs, freq)
    alpha, open_ = F.sin(w) / (q * 2.0), 1.0 + F.cos(w)
    return section(open_ / 2.0, -open_, open_ / 2.0, 1.0 + alpha, F.cos(w) * -2.0, 1.0 - alpha)


def all_pass(fs: Column, freq: Column, q: Column) -> Column:
    w = _angle(fs, freq)
    alpha, mid = F.sin(w) / (q * 2.0), F.cos(w) * -2.0
    return section(1.0 - alpha, mid, 1.0 + alpha, 1.0 + alpha, mid, 1.0 - alpha)


def flat_gain(gain: Column) -> Column:
    zero = F.lit(0.0)
    return section(F.pow(F.lit(10.0), gain / 20.0), zero, zero, F.lit(1.0), zero, zero)


def linkwitz_transform(fs: Column, f0: Column, q0: Column, fp: Column, qp: Column) -> Column:
    """Moves a (f0, q0) pole pair to (fp, qp); bilinear, warped at the mean frequency."""
    mean = (f0 + fp) / 2.0
    s = mean * (2.0 * math.pi) / F.tan(mean * math.pi / fs)
    z0, zp = f0 * (2.0 * math.pi), fp * (2.0 * math.pi)

    def quadratic(w: Column, q: Column) -> tuple[Column, Column, Column]:
        return w * w + s * w / q + s * s, (w * w - s * s) * 2.0, w * w - s * w / q + s * s

    return section(*quadratic(z0, q0), *quadratic(zp, qp))


def of_kind(kind: str, fs: Column, freq: Column, q: Column, gain: Column) -> Column:
    """The section of one known kind."""
    makers = {
        "PeakingEQ": lambda: peaking(fs, freq, q, gain),
        "LowShelf": lambda: low_shelf(fs, freq, q, gain),
        "HighShelf": lambda: high_shelf(fs, freq, q, gain),
        "LowPass1": lambda: low_pass_1(fs, freq),
        "HighPass1": lambda: high_pass_1(fs, freq),
        "LowPass2": lambda: low_pass_2(fs, freq, q),
        "HighPass2": lambda: high_pass_2(fs, freq, q),
        "AllPass": lambda: all_pass(fs, freq, q),
        "Gain": lambda: flat_gain(gain),
        "Passthrough": lambda: flat_gain(F.lit(0.0)),
    }
    return makers[kind]()


def coefficients(kind: Column, fs: Column, freq: Column, q: Column, gain: Column,
                 f0: Column | None = None, q0: Column | None = None,
                 fp: Column | None = None, qp: Column | None = None) -> Column:
    """The section of a kind held in a column; null for an unknown kind."""
    out = F.when(F.lit(False), flat_gain(F.lit(0.0)))
    for name in KINDS:
        if name != "LinkwitzTransform":
            out = out.when(kind == name, of_kind(name, fs, freq, q, gain))
        elif f0 is not None:
            out = out.when(kind == name, linkwitz_transform(fs, f0, q0, fp, qp))
    return out


def design(parts, fs) -> Column:
    """The cascade of a literal design, [(kind, freq, q, gain), ...], as an array of
    sections at rate ``fs`` (a number or a column)."""
    rate = fs if isinstance(fs, Column) else F.lit(fs)
    return F.array(*[of_kind(k, rate, F.lit(float(f)), F.lit(float(q)), F.lit(float(g))) for k, f, q, g in parts])


def _half_power(c0: Column, c1: Column, c2: Column, phi: Column) -> Column:
    """|c0 + c1 z^-1 + c2 z^-2|^2 with phi = sin^2(w/2): stays accurate near DC."""
    total = c0 + c1 + c2
    return total * total - phi * 4.0 * (c0 * c1 + c0 * c2 * 4.0 + c1 * c2) + phi * phi * 16.0 * c0 * c2


def response_db(s: Column, w: Column) -> Column:
    """Magnitude of section ``s`` at angular frequency ``w`` (radians per sample)."""
    phi = F.pow(F.sin(w / 2.0), F.lit(2.0))
    num = _half_power(s["b0"], s["b1"], s["b2"], phi)
    den = _half_power(F.lit(1.0), s["a1"], s["a2"], phi)
    return 10.0 * F.log10(F.greatest(num / den, F.lit(1e-300)))


def response_degrees(s: Column, w: Column) -> Column:
    """Phase of section ``s``, in (-180, 180]."""
    sin1, cos1 = F.sin(w), F.cos(w)
    sin2, cos2 = sin1 * cos1 * 2.0, cos1 * cos1 * 2.0 - 1.0

    def parts(c0: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
        return c0 + c1 * cos1 + c2 * cos2, -(c1 * sin1) - c2 * sin2

    br, bi = parts(s["b0"], s["b1"], s["b2"])
    ar, ai = parts(F.lit(1.0), s["a1"], s["a2"])
    return F.degrees(F.atan2(bi * ar - br * ai, br * ar + bi * ai))


def wrap_degrees(d: Column) -> Column:
    """Into (-180, 180]."""
    return d - F.ceil((d - 180.0) / 360.0) * 360.0


def dc_delay_samples(s: Column) -> Column:
    """Group delay at DC in samples; null where the response at DC is zero."""
    num, den = s["b0"] + s["b1"] + s["b2"], 1.0 + s["a1"] + s["a2"]
    ahead = (s["b1"] + s["b2"] * 2.0) / F.nullif(num, F.lit(0.0))
    return ahead - (s["a1"] + s["a2"] * 2.0) / F.nullif(den, F.lit(0.0))


def _pair(gain: Column) -> Column:
    amp = F.pow(F.lit(10.0), gain / 40.0)
    return amp + 1.0 / amp


def shelf_slope(q: Column, gain: Column) -> Column:
    return 1.0 / ((1.0 / (q * q) - 2.0) / _pair(gain) + 1.0)


def shelf_q(slope: Column, gain: Column) -> Column:
    return 1.0 / F.sqrt(_pair(gain) * (1.0 / slope - 1.0) + 2.0)


def steepest_slope(gain: Column) -> Column:
    return 1.0 / (STEEPEST_SHELF_TERM / _pair(gain) + 1.0)


def pass_q_to_device(q: Column) -> Column:
    return q * math.sqrt(2.0)


def pass_q_from_device(q: Column) -> Column:
    return q / math.sqrt(2.0)
