"""Row-local and neighbour operators on sample series.

A series is a table (keys..., i, v) with one row per sample, or its stored form
(keys..., block_no, start_i, samples) with one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.functions import levels
from lowtide.operators.ordering import running_sum, with_group_agg

BLOCK = 4096


def to_blocks(samples: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Pack rows into blocks of ``block`` samples; a group never exceeds one block."""
    keys = list(keys)
    packed = samples.groupBy(*keys, F.floor(F.col("i") / block).alias("block_no")).agg(
        F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s")
    )
    return packed.select(
        *keys, "block_no", F.col("_s")[0]["i"].alias("start_i"), F.col("_s")["v"].alias("samples")
    )


def from_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocks.select(*keys, "start_i", F.posexplode("samples").alias("_p", "v")).select(
        *keys, (F.col("start_i") + F.col("_p")).alias("i"), "v"
    )


def map_blocks(blocks: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a row-local sample function inside stored blocks."""
    return blocks.withColumn("samples", F.transform("samples", fn))


def lengths(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg((F.max("i") + 1).alias("n"))


def adjust_gain(samples: DataFrame, ratio: Column | float) -> DataFrame:
    return samples.withColumn("v", F.col("v") * ratio)


def offset(samples: DataFrame, db: float | Column) -> DataFrame:
    if not isinstance(db, Column) and abs(db) < 1e-9:
        return samples
    return samples.withColumn("v", F.col("v") * levels.gain_ratio(db))


def clip(samples: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    return samples.withColumn("v", levels.clip(F.col("v"), low, high))


def invert(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", -F.col("v"))


def zero(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", F.lit(0.0))


def copy_as(samples: DataFrame, new_id: Column, id_col: str = "signal_id") -> DataFrame:
    return samples.withColumn(id_col, new_id)


def waveform_db(samples: DataFrame) -> DataFrame:
    return samples.withColumn("db", levels.waveform_db(F.col("v")))


def time_axis(samples: DataFrame) -> DataFrame:
    return samples.withColumn("t", F.col("i") / F.col("fs"))


def cut(samples: DataFrame, keys: Sequence[str], start_s: float, end_s: float) -> DataFrame:
    """Samples from start to end seconds, end sample included. A range outside the
    signal leaves that signal as it is. Positions are kept."""
    sized = with_group_agg(samples, keys, _n=F.max("i") + 1)
    seconds = F.col("_n") / F.col("fs")
    outside = (F.lit(float(start_s)) >= seconds) | (F.lit(float(end_s)) > seconds)
    first = F.floor(F.lit(float(start_s)) * F.col("fs"))
    last = F.floor(F.lit(float(end_s)) * F.col("fs"))
    return sized.where(outside | F.col("i").between(first, last)).drop("_n")


def whole_samples(ms: float | Column) -> Column:
    """A time as whole samples at the row's rate."""
    return F.floor((ms if isinstance(ms, Column) else F.lit(float(ms))) * F.col("fs") / 1000.0).cast("long")


def moved(sized: DataFrame, by: Column, low: Column, high: Column) -> DataFrame:
    """Rows (keys..., i, v, _n) moved by ``by`` samples in all, having been as far as ``low`` and ``high`` on the way;
    what has left the signal is silence.

    Positions turn round at the ends: a row that falls out becomes the silence of a place left empty, so no other row is
    made and none is lost.
    """
    stays = (F.col("i") >= F.greatest(-low, F.lit(0))) & (F.col("i") < F.col("_n") - F.greatest(high, F.lit(0)))
    return sized.withColumns({"i": F.pmod(F.col("i") + by, F.col("_n")), "v": F.when(stays, F.col("v")).otherwise(0.0)}).drop("_n")


def shift(samples: DataFrame, keys: Sequence[str], ms: float | Column) -> DataFrame:
    """Delay (positive) or advance (negative) by whole samples, length kept; the
    vacated end is silence."""
    keys = list(keys)
    sized = with_group_agg(samples.select(*keys, "i", "v", "fs"), keys, _n=F.max("i") + 1)
    by = whole_samples(ms)
    return moved(sized, by, by, by)


def step_response(samples: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """Cumulative trapezoid: running sum less half of the first and the last sample."""
    summed = running_sum(samples, keys, "i", F.col("v"), "_sum", block)
    firsts = samples.where(F.col("i") == 0).select(*keys, F.col("v").alias("_v0"))
    joined = summed.join(firsts, list(keys))
    y = (F.col("_sum") - (F.col("_v0") + F.col("v")) / 2.0) / F.col("fs")
    return joined.withColumn("y", y).drop("_sum", "_v0")


def concatenate(
    samples: DataFrame, key: str, plan: DataFrame, group: str = "merged_id", ordinal: str = "ord"
) -> DataFrame:
    """Lay signals end to end. ``plan`` says (key, group, ordinal) for each input;
    the start of each is the running sum of the lengths before it. The result
    takes its rate from the first input."""
    sized = lengths(samples, [key]).join(plan, key)
    starts = running_sum(sized, [group], ordinal, F.col("n"), "_start", inclusive=False)
    rates = samples.where(F.col("i") == 0).select(key, F.col("fs").alias("_fs"))
    led = (
        starts.join(rates, key)
        .groupBy(group)
        .agg(F.min_by("_fs", ordinal).alias("fs"))
    )
    return (
        samples.drop("fs")
        .join(starts.select(key, group, "_start"), key)
        .join(led, group)
        .select(group, (F.col("i") + F.col("_start")).alias("i"), "v", "fs")
    )


def total_seconds(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return signals.groupBy(*by).agg(F.sum(F.col("n") / F.col("fs")).alias("seconds"))


def _centred(n: Column) -> Column:
    """A unit sample in the middle of ``n`` places."""
    return F.when(F.col("i") == F.floor(n / 2), 1.0).otherwise(0.0)


def pulse(spark, fs: int) -> DataFrame:
    """Four seconds of silence with a unit sample in the middle."""
    n = 4 * fs
    return spark.range(n).select(F.col("id").alias("i")).select("i", _centred(F.lit(n)).alias("v"), F.lit(fs).alias("fs"))


def pulses(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for each row of (keys..., n): silence of its own length with a unit sample in the middle."""
    grid = signals.where("n > 0").select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return grid.select(*keys, "i", _centred(F.col("n")).alias("v"))


def impulses(signals: DataFrame, keys: Sequence[str], seconds: float = 1.0) -> DataFrame:
    """A unit impulse (``v``) and a unit step (``step``) for each row, at the row's rate."""
    last = F.floor(F.col("fs") * seconds).cast("long") - 1
    grid = signals.select(*keys, "fs", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return grid.withColumn("v", F.when(F.col("i") == 0, 1.0).otherwise(0.0)).withColumn("step", F.lit(1.0))


def impulse_blocks(signals: DataFrame, keys: Sequence[str], seconds: float = 1.0, block: int = BLOCK) -> DataFrame:
    """``impulses`` as stored blocks (keys..., fs, block_no, start_i, samples, step) beside the other columns of ``signals``.
    They are made where the row is: no sample is shuffled."""
    n = F.floor(F.col("fs") * seconds).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(block).cast("long")))
    each = signals.withColumn("_n", n).where("_n > 0").withColumn("start_i", starts)
    here = F.least(F.lit(block).cast("long"), F.col("_n") - F.col("start_i")).cast("int")
    first = F.array(F.when(F.col("start_i") == 0, 1.0).otherwise(0.0))
    return each.withColumns({
        "block_no": F.floor(F.col("start_i") / block).cast("long"), "samples": F.concat(first, F.array_repeat(F.lit(0.0), here - 1)),
        "step": F.array_repeat(F.lit(1.0), here),
    }).drop("_n")
