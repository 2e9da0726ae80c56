"""Levels, dynamics, extension and ratings. All are partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.functions.levels import SILENCE_DB
from lowtide.operators.ordering import exact_quantile

# Integration times in seconds, and rating thresholds (best first).
INTEGRATION = {"instant": 0.035, "fast": 0.125, "slow": 1.0}
LEVEL_STEPS = (-15.5, -18.0, -20.5, -23.0)
DYNAMICS_STEPS = (27.5, 25.0, 22.5, 20.0)
EXTENSION_STEPS = (10.0, 15.0, 20.0, 25.0)


def level_columns() -> dict[str, Column]:
    """Aggregates over ``v``: rms, peak, crest factor and headroom in dB."""
    power = F.avg(F.col("v") * F.col("v"))
    top = F.max(F.abs("v"))
    return {
        "rms_db": 10.0 * F.log10(power),
        "peak_db": 20.0 * F.log10(top),
        "crest_db": 20.0 * F.log10(top) - 10.0 * F.log10(power),
        "headroom_db": -20.0 * F.log10(top),
    }


def levels(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(*[c.alias(n) for n, c in level_columns().items()])


def headroom(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg((-20.0 * F.log10(F.max(F.abs("v")))).alias("headroom_db"))


def windowed_peaks(samples: DataFrame, keys: Sequence[str], times: dict[str, float] | None = None) -> DataFrame:
    """Loudest non-overlapping window per integration time (keys..., kind, db). A
    short last window counts as if padded with silence."""
    times = times or INTEGRATION
    choices = F.array(*[
        F.struct(F.lit(name).alias("kind"), F.floor(F.col("fs") * F.lit(float(s))).cast("long").alias("win"))
        for name, s in times.items()
    ])
    rows = samples.select(*keys, "i", "v", F.explode(choices).alias("_w"))
    rows = rows.select(*keys, F.col("_w.kind").alias("kind"), F.col("_w.win").alias("win"), "i", "v")
    each = rows.groupBy(*keys, "kind", "win", F.floor(F.col("i") / F.col("win")).alias("w")).agg(
        F.sum(F.col("v") * F.col("v")).alias("e")
    )
    db = F.when(F.col("e") > 0, 10.0 * F.log10(F.col("e") / F.col("win"))).otherwise(SILENCE_DB)
    return each.groupBy(*keys, "kind").agg(F.max(db).alias("db"))


def composite(levels_long: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Energy mean of the chosen levels."""
    chosen = levels_long.where(F.col("kind").isin(*kinds))
    mean = F.avg(F.pow(F.lit(10.0), F.col("db") / 10.0))
    return chosen.groupBy(*keys).agg((10.0 * F.log10(mean)).alias("composite_db"))


def _rate(v: Column, steps: Sequence[float], better) -> Column:
    out = F.lit(1)
    for stars, step in zip(range(5 - len(steps) + 1, 6), reversed(list(steps))):
        out = F.when(better(v, F.lit(step)), stars).otherwise(out)
    return out


def rate_level(db: Column, adjust: float = 0.0) -> Column:
    return _rate(db + F.lit(float(adjust)), LEVEL_STEPS, lambda v, s: v >= s)


def rate_dynamics(spread: Column) -> Column:
    return _rate(spread, DYNAMICS_STEPS, lambda v, s: v >= s)


def rate_extension(hz: Column) -> Column:
    return _rate(hz, EXTENSION_STEPS, lambda v, s: v < s)


def extension(curve: DataFrame, keys: Sequence[str], limit_db: float) -> DataFrame:
    """(keys..., peak_f, peak_db, low_f, low_db): the peak and the lowest frequency
    still within ``limit_db`` (negative) of it."""
    keys = list(keys)
    tops = curve.groupBy(*keys).agg(
        F.max("db").alias("peak_db"), F.max_by("f", F.struct(F.col("db"), -F.col("f"))).alias("peak_f")
    )
    near = curve.join(tops, keys).where(F.col("db") >= F.col("peak_db") + limit_db)
    low = near.groupBy(*keys, "peak_f", "peak_db").agg(F.min("f").alias("low_f"))
    return low.withColumn("low_db", F.col("peak_db") + limit_db)


def extension_rating(peak_ext: DataFrame, avg_ext: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which curve sets the lower limit, and its rating."""
    p = peak_ext.select(*keys, F.col("peak_f").alias("pf"), F.col("low_f").alias("pl"))
    a = avg_ext.select(*keys, F.col("peak_f").alias("af"), F.col("low_f").alias("al"))
    both = p.join(a, list(keys))
    same = F.abs(F.col("pf") - F.col("af")) <= F.greatest(F.abs("pf"), F.abs("af")) * 1e-9
    use_peak = (~same & (F.col("pf") > F.col("af"))) | (same & (F.col("pl") <= F.col("al")))
    out = both.select(
        *keys, F.when(use_peak, "Peak").otherwise("Average").alias("source"),
        F.when(use_peak, F.col("pl")).otherwise(F.col("al")).alias("low_f"),
    )
    return out.withColumn("rating", rate_extension(F.col("low_f")))


def peak_position(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    first = F.max_by(F.col("i"), F.struct(F.col("v"), -F.col("i")))
    return samples.groupBy(*keys).agg((first / F.max("fs")).alias("peak_t"))


def hms(seconds: Column) -> Column:
    """h:mm:ss with microseconds where the time is not whole seconds."""
    micros = F.round(seconds * 1e6).cast("long")
    whole = F.floor(micros / 1000000)
    base = F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
    return F.when(micros % 1000000 == 0, base).otherwise(
        F.concat(base, F.format_string(".%06d", micros % 1000000))
    )


def durations(samples: DataFrame, keys: Sequence[str], start_s: float = 0.0) -> DataFrame:
    sized = samples.groupBy(*keys).agg(((F.max("i") + 1) / F.max("fs")).alias("seconds"))
    return sized.select(
        *keys, "seconds", hms(F.col("seconds")).alias("duration"), hms(F.lit(float(start_s))).alias("start"),
        hms(F.col("seconds") + float(start_s)).alias("end"),
    )


def sweep_summary(results: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and population deviation per group; the median is exact and
    does not gather a group."""
    plain = results.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return plain.join(exact_quantile(results, [by], value, 0.5, "median").drop("n"), by)
