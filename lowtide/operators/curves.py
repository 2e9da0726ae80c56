"""Operators on frequency curves (keys..., f, db).

A curve is one bounded grid (at most a few ten thousand points), so windows over
a curve are bounded too; the number of curves is not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowtide.functions import bands, levels

# Fixed values.
SAVGOL_WINDOW, SAVGOL_ORDER = 101, 7
FRACTIONS = (1, 2, 3, 6, 12, 24)
TOLERANCE = 1e-5
MAGNITUDE_FLOOR = 1e-7


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Three-point slope at an end, kept monotone."""
    s = ((h0 * 2.0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (
        F.when(F.signum(s) != F.signum(d0), 0.0)
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(s) > F.abs(d0) * 3.0), d0 * 3.0)
        .otherwise(s)
    )


def _knots(curve: DataFrame, keys: list[str], smooth: bool) -> DataFrame:
    """Each point with its right neighbour and, if smooth, both slopes."""
    w = Window.partitionBy(*keys).orderBy("f")
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    k = curve.select(*keys, "f", "db").withColumn("f1", at("f", 1)).withColumn("y1", at("db", 1))
    if not smooth:
        return k
    k = k.withColumn("_h", F.col("f1") - F.col("f")).withColumn("_d", (F.col("y1") - F.col("db")) / F.col("_h"))
    for name, shift in (("_hp", -1), ("_hpp", -2), ("_hn", 1)):
        k = k.withColumn(name, at("_h", shift))
    for name, shift in (("_dp", -1), ("_dpp", -2), ("_dn", 1)):
        k = k.withColumn(name, at("_d", shift))
    h, d, hp, dp = F.col("_h"), F.col("_d"), F.col("_hp"), F.col("_dp")
    left, right = h * 2.0 + hp, h + hp * 2.0
    inner = F.when(d * dp <= 0, 0.0).otherwise((left + right) / (left / dp + right / d))
    slope = (
        F.when(dp.isNull() & d.isNull(), 0.0)
        .when(dp.isNull(), F.when(F.col("_dn").isNull(), d).otherwise(_end_slope(h, F.col("_hn"), d, F.col("_dn"))))
        .when(d.isNull(), F.when(F.col("_dpp").isNull(), dp).otherwise(_end_slope(hp, F.col("_hpp"), dp, F.col("_dpp"))))
        .otherwise(inner)
    )
    k = k.withColumn("s0", slope)
    return k.withColumn("s1", at("s0", 1)).select(*keys, "f", "db", "f1", "y1", "s0", "s1")


def interpolate(curve: DataFrame, grid: DataFrame, keys: Sequence[str], smooth: bool = True) -> DataFrame:
    """Value of each key's curve at the grid points (keys..., f).

    Curve and grid are merged by one sort per key; every grid point takes the last
    knot at or below it. Linear values are held outside the curve; the monotone
    cubic (default) runs on along its end pieces.
    """
    keys = list(keys)
    knots = _knots(curve, keys, smooth)
    names = [c for c in knots.columns if c not in keys and c != "f"]
    packed = knots.select(*keys, "f", F.struct("f", *names).alias("_k"))
    empty = grid.select(*keys, "f", F.lit(None).cast(packed.schema["_k"].dataType).alias("_k"))
    both = packed.unionByName(empty)
    w = Window.partitionBy(*keys).orderBy("f", F.col("_k").isNull())
    before = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opening = F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    piece_before = F.last(F.when(F.col("_k.f1").isNotNull(), F.col("_k")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    at = both.withColumn("_a", F.coalesce(before, opening)).withColumn("_p", F.coalesce(piece_before, opening))
    at = at.where(F.col("_k").isNull() & F.col("_a").isNotNull())
    a, p, x = F.col("_a"), F.col("_p"), F.col("f")
    if smooth:
        h = p["f1"] - p["f"]
        t = (x - p["f"]) / h
        value = (
            p["db"] * (1.0 + t * 2.0) * (1.0 - t) * (1.0 - t) + p["s0"] * h * t * (1.0 - t) * (1.0 - t)
            + p["y1"] * t * t * (3.0 - t * 2.0) + p["s1"] * h * t * t * (t - 1.0)
        )
        value = F.when(h.isNull() | (x == a["f"]), a["db"]).otherwise(value)
    else:
        inside = a["f1"].isNotNull() & (x > a["f"])
        value = F.when(inside, a["db"] + (a["y1"] - a["db"]) * (x - a["f"]) / (a["f1"] - a["f"])).otherwise(a["db"])
    return at.select(*keys, "f", value.alias("db"))


def _extent(curve: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return curve.groupBy(*keys).agg(
        F.min("f").alias(f"{tag}_lo"), F.max("f").alias(f"{tag}_hi"), F.count(F.lit(1)).alias(f"{tag}_n")
    )


def rescale(curve: DataFrame, keys: Sequence[str], points: int = 32769, smooth: bool = True) -> DataFrame:
    """Onto ``points`` equal steps from the first to (not including) the last frequency."""
    keys = list(keys)
    ends = _extent(curve, keys, "c")
    step = (F.col("c_hi") - F.col("c_lo")) / points
    grid = ends.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return interpolate(curve, grid.select(*keys, (F.col("c_lo") + F.col("_j") * step).alias("f")), keys, smooth)


def _on_one_grid(curve: DataFrame, other: DataFrame, keys: list[str], smooth: bool, own: Column, kept: Column) -> DataFrame:
    """(keys..., f, _a, _b): both curves on the grid of one of them, ``own`` says per key whether the first's; only the
    side whose grid differs is interpolated, since at its own points a curve has its own values."""
    ends = _extent(curve, keys, "c").join(_extent(other, keys, "t"), keys)
    points = curve.select(*keys, "f", "db", F.lit(True).alias("_own")).unionByName(other.select(*keys, "f", "db", F.lit(False).alias("_own")))
    grid = points.join(ends, keys).where((F.col("_own") == own) & kept).select(*keys, "f", "db", "_own")
    across = interpolate(other, grid.where("_own"), keys, smooth).unionByName(interpolate(curve, grid.where("NOT _own"), keys, smooth))
    met = grid.join(across.withColumnRenamed("db", "_there"), [*keys, "f"])
    here, there = F.col("db"), F.col("_there")
    return met.select(*keys, "f", F.when(F.col("_own"), here).otherwise(there).alias("_a"), F.when(F.col("_own"), there).otherwise(here).alias("_b"))


def normalise(curve: DataFrame, target: DataFrame, keys: Sequence[str], smooth: bool = True) -> DataFrame:
    """Difference to the target over their common range, on the finer of the two grids."""
    keys = list(keys)
    fine = (F.col("c_hi") - F.col("c_lo")) / (F.col("c_n") - 1) <= (F.col("t_hi") - F.col("t_lo")) / (F.col("t_n") - 1)
    common = F.col("f").between(F.greatest("c_lo", "t_lo"), F.least("c_hi", "t_hi"))
    out = _on_one_grid(curve, target, keys, smooth, fine, common)
    return out.select(*keys, "f", (F.col("_a") - F.col("_b")).alias("db"))


def apply_filter(curve: DataFrame, response: DataFrame, keys: Sequence[str], smooth: bool = True) -> DataFrame:
    """Curve plus filter response in dB; the grid with more points is kept."""
    keys = list(keys)
    out = _on_one_grid(curve, response, keys, smooth, F.col("c_n") >= F.col("t_n"), F.lit(True))
    return out.select(*keys, "f", (F.col("_a") + F.col("_b")).alias("db"))


def uneven(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose grid is not equally spaced to three decimals."""
    w = Window.partitionBy(*keys).orderBy("f")
    steps = curve.select(*keys, F.round(F.col("f") - F.lag("f").over(w), 3).alias("_s")).where("_s is not null")
    return steps.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).where("_lo <> _hi").select(*keys)


def smooth_octaves(curve: DataFrame, keys: Sequence[str], fractions: Sequence[int] = FRACTIONS) -> DataFrame:
    """Fractional-octave smoothing for several fractions in one job: the band of each
    point is computed, amplitudes are summed per band, empty bands are zero."""
    keys = list(keys)
    b = F.explode(F.array(*[F.lit(x) for x in fractions])).alias("fraction")
    ends = curve.groupBy(*keys).agg(F.max("f").alias("_top")).select(*keys, "_top", b)
    start = F.when(F.col("fraction") < 12, 5.0).otherwise(10.0)
    fraction = F.col("fraction")
    ends = ends.withColumn(
        "band",
        F.explode(F.sequence(bands.index_of(start, fraction), bands.index_of(F.least(F.lit(20000.0), F.col("_top")), fraction))),
    ).drop("_top")
    rows = curve.where(F.col("f") > 0).select(*keys, "f", levels.amplitude_from_db(F.col("db")).alias("_a"), b)
    sums = rows.groupBy(*keys, "fraction", bands.holding(F.col("f"), fraction).alias("band")).agg(F.sum("_a").alias("_a"))
    out = ends.join(sums, [*keys, "fraction", "band"], "left")
    amp = F.coalesce(F.col("_a"), F.lit(0.0))
    out = out.withColumn("_db", levels.db_from_power(amp * amp))
    top = F.max("_db").over(Window.partitionBy(*keys, "fraction"))
    return out.select(
        *keys, "fraction", "band", bands.centre(F.col("band"), fraction).alias("f"),
        F.greatest(F.col("_db"), top - levels.DYNAMIC_RANGE_DB).alias("db"),
    )


def band_table(limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bands of each row's (fraction, f_start, f_stop)."""
    fraction = F.col("fraction")
    n = F.explode(F.sequence(bands.index_of(F.col("f_start"), fraction), bands.index_of(F.col("f_stop"), fraction)))
    out = limits.select(*keys, "fraction", n.alias("band")).withColumn("center", bands.centre(F.col("band"), fraction))
    return out.select(
        *keys, "fraction", "band", "center", bands.lower(F.col("center"), fraction).alias("lower"),
        bands.upper(F.col("center"), fraction).alias("upper"), bands.nominal(F.col("band"), fraction).alias("nominal"),
    )


def _savgol(window: int, order: int):
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1) / max(half, 1), order + 1, increasing=True)
    fit = np.linalg.pinv(basis)  # polynomial coefficients of a window
    hat = basis @ fit  # fitted value at each place of a window

    def smooth(values: pd.Series) -> pd.Series:
        out = []
        for y in values:
            y = np.asarray(y, dtype=float)
            if len(y) < window:
                out.append(np.full(len(y), np.nan))
                continue
            inner = np.convolve(y, hat[half][::-1], mode="valid")
            out.append(np.concatenate([(hat @ y[:window])[:half], inner, (hat @ y[-window:])[half + 1:]]))
        return pd.Series(out)

    return F.pandas_udf(smooth, T.ArrayType(T.DoubleType())).asNondeterministic()


def smooth_polynomial(curve: DataFrame, keys: Sequence[str], kind: str = "SG") -> DataFrame:
    """Savitzky-Golay smoothing; ``SG`` or ``SG/window/order``. Ends are fitted too. A curve of fewer points than the
    window cannot be smoothed: its levels are NaN, and other curves are not held up by it."""
    parts = kind.split("/")
    window, order = (int(parts[1]), int(parts[2])) if len(parts) > 1 else (SAVGOL_WINDOW, SAVGOL_ORDER)
    whole = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f", "db"))).alias("_c"))
    done = whole.select(*keys, F.arrays_zip(
        F.col("_c")["f"].alias("f"), _savgol(window, order)(F.col("_c")["db"]).alias("db")
    ).alias("_z"))
    return done.select(*keys, F.explode("_z").alias("_z")).select(*keys, "_z.f", "_z.db")


def equal_energy(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tilt by 10 log10 of an equally spaced axis from the second to the last point."""
    w = Window.partitionBy(*keys).orderBy("f")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole)
    low, high = F.nth_value("f", 2).over(whole), F.last("f").over(whole)
    axis = low + (high - low) * k / (n - 1)
    return curve.select(*keys, "f", (F.col("db") + 10.0 * F.log10(axis)).alias("db"))


def magnitude_phase(points: DataFrame, scale: float = 1.0, ref: float = 1.0) -> DataFrame:
    """dB and degrees of (re, im)."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * (scale / ref)
    return points.withColumn("db", levels.amplitude_db(size, MAGNITUDE_FLOOR)).withColumn(
        "degrees", F.degrees(F.atan2("im", "re"))
    )


def choose(curves: DataFrame, kinds: Sequence[str], filtered: bool | None = None) -> DataFrame:
    """Curves of the given kinds (avg, peak, median) by name; filtered, unfiltered or both."""
    tail = {True: "-filtered", False: "", None: "(-filtered)?"}[filtered]
    return curves.where(F.col("name").rlike(f"^.*_({'|'.join(kinds)}){tail}$"))


def value_at(curve: DataFrame, keys: Sequence[str], freq: float, step: float = 1.0) -> DataFrame:
    """Linear value on a regular grid at (or just below) a frequency, three decimals."""
    starts = curve.groupBy(*keys).agg(F.min("f").alias("_lo"))
    at = F.col("_lo") + F.floor((F.lit(float(freq)) - F.col("_lo")) / step) * step
    out = interpolate(curve, starts.select(*keys, at.alias("f")), keys, smooth=False)
    return out.withColumn("db", F.round("db", 3))


def level_range(curve: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    part = curve.where((F.col("f") >= low) & (F.col("f") < high))
    return part.groupBy(*keys).agg(F.floor(F.min("db")).alias("min_db"), F.ceil(F.max("db")).alias("max_db"))


def crossover(low_pass: DataFrame, high_pass: DataFrame, keys: Sequence[str], fc: float) -> DataFrame:
    """Where the high pass first meets the low pass, and the slope of each over an
    octave away from the target. A search that finds nothing takes the first point."""
    both = low_pass.select(*keys, "f", F.col("db").alias("_lp")).join(
        high_pass.select(*keys, "f", F.col("db").alias("_hp")), [*keys, "f"]
    )

    def first_over(value: str, limit: float) -> Column:
        return F.coalesce(F.min_by(value, F.when(F.col("f") > limit, F.col("f"))), F.min_by(value, "f"))

    return both.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("_hp") >= F.col("_lp"), F.col("f"))), F.min("f")).alias("fc"),
        (first_over("_lp", fc * 4) - first_over("_lp", fc * 8)).alias("lp_slope"),
        (first_over("_hp", fc / 4) - first_over("_hp", fc / 8)).alias("hp_slope"),
    )


def impulse_display(samples: DataFrame, selection: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Time centred on the middle in ms, level in percent of the selection's peak."""
    tops = samples.groupBy(*selection).agg(F.max(F.abs("v")).alias("_top"))
    sizes = samples.groupBy(*keys).agg(((F.max("i") + 1) / F.max("fs")).alias("_s"))
    joined = samples.join(tops, list(selection)).join(sizes, list(keys))
    return joined.select(
        *dict.fromkeys([*selection, *keys]), "i", ((F.col("i") / F.col("fs") - F.col("_s") / 2.0) * 1000.0).alias("t_ms"),
        (F.col("v") * 100.0 / F.col("_top")).alias("percent"),
    )


def nearly_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, whether both curves have the same grid and close values."""
    left = a.select(*keys, "f", F.col("db").alias("_a"))
    right = b.select(*keys, "f", F.col("db").alias("_b"))
    close = F.abs(F.col("_a") - F.col("_b")) <= F.lit(TOLERANCE) + F.abs("_b") * TOLERANCE
    both = left.join(right, [*keys, "f"], "full_outer")
    return both.groupBy(*keys).agg(F.bool_and(F.coalesce(close, F.lit(False))).alias("equal"))
