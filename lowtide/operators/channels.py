"""Multichannel operators: bass management, mixing, channel operations, links.

Samples carry (title, channel, i, v, fs); blocks carry (title, channel, block_no,
start_i, samples, fs). Sums over channels group by (title, position), which is
never larger than the number of channels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.functions import biquad, levels
from lowtide.functions.tables import MONO_LFE_DB, MONO_MAIN_DB, REMIX_LFE_DB, REMIX_MAIN_DB
from lowtide.operators import recursive as R
from lowtide.operators import samples as S
from lowtide.operators import stats
from lowtide.operators.ordering import with_group_agg
from lowtide.session import materialise

LFE = "LFE"
LR4_Q = biquad.BUTTERWORTH_Q


def is_lfe(name: Column) -> Column:
    return name.endswith("_" + LFE) | (name == LFE)


def fourth_order(kind: str, fs: Column, freq: Column) -> Column:
    """Flat cascade of a fourth-order Linkwitz-Riley pass filter."""
    one = biquad.of_kind(kind, fs, freq, F.lit(LR4_Q), F.lit(0.0))
    return R.flat_sos(F.array(one, one))


def no_filter(sections: int = 1) -> Column:
    return F.array(*[F.lit(x) for _ in range(sections) for x in (1.0, 0.0, 0.0, 0.0, 0.0)])


def headroom_db(kind: Column, channels: Column) -> Column:
    """Room for the worst-case sum (WCS), or a fixed figure plus 10 dB."""
    worst = 20.0 * F.log10(channels - 1 + 10.0 ** 0.5)
    return F.when(kind == "WCS", worst).otherwise(F.abs(kind.try_cast("double")) + 10.0)


def sum_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample-wise sum over channels; a missing sample counts as zero."""
    keys = list(keys)
    met = blocks.groupBy(*keys, "block_no", "start_i", "fs").agg(
        F.array_sort(F.collect_list(F.struct("channel", "samples")))["samples"].alias("_all")
    )
    zero = F.lit(0.0)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))
    return met.withColumn("samples", F.aggregate("_all", F.array().cast("array<double>"), add)).drop("_all")


def bass_manage(blocks: DataFrame, config: DataFrame, keys: Sequence[str] = ("title",)) -> DataFrame:
    """One bass-managed output per title.

    ``config`` has (title, lpf_hz, lpf_position, headroom_type, clip_before,
    clip_after). Mains are cut by the headroom, LFE by 10 dB less; the low pass is
    designed at the signal's own rate and sits before the sum on all channels,
    after it, or nowhere. A ``lpf_lfe`` column of false leaves the LFE out of the low pass before the sum; without it all
    channels take part. An optional ``sos`` column is each channel's filter.
    """
    keys = list(keys)
    if "lpf_lfe" not in config.columns:
        config = config.withColumn("lpf_lfe", F.lit(True))
    # Every channel has one first block, so no other block is looked at.
    counts = blocks.where("start_i = 0").groupBy(*keys).agg(F.count_distinct("channel").alias("_channels"))
    df = blocks.join(config, keys).join(counts, keys)
    room = headroom_db(F.col("headroom_type"), F.col("_channels"))
    gain = levels.gain_ratio(F.when(is_lfe(F.col("channel")), 10.0 - room).otherwise(-room))
    df = df.withColumn("_gain", gain).withColumn("samples", F.transform("samples", lambda v: v * F.col("_gain")))
    lpf = fourth_order("LowPass2", F.col("fs"), F.col("lpf_hz"))

    def low_passed(rows: DataFrame, position: str, by: list[str]) -> DataFrame:
        """Only titles with the low pass here run it; the others go by."""
        here = F.coalesce(F.col("lpf_position") == position, F.lit(False))
        if position == "Before":
            here &= ~is_lfe(F.col("channel")) | F.coalesce(F.col("lpf_lfe"), F.lit(True))
        done = R.cascade(rows.where(here).withColumn("sos", lpf), by)
        return done.unionByName(rows.where(~here).withColumn("samples", F.col("samples").cast("array<double>")).select(*done.columns))

    def clipped(rows: DataFrame, flag: str) -> DataFrame:
        on = F.transform("samples", lambda v: levels.clip(v))
        return rows.withColumn("samples", F.when(F.col(flag), on).otherwise(F.col("samples")))

    settings = ["lpf_hz", "lpf_position", "lpf_lfe", "clip_before", "clip_after"]
    own = "sos" in blocks.columns
    if own:
        df = df.withColumnRenamed("sos", "_own")
    carried = [*keys, "channel", "block_no", "start_i", "fs", "samples", *settings, *(["_own"] if own else [])]
    before = low_passed(df.select(*carried), "Before", [*keys, "channel"])
    before = clipped(before, "clip_before")
    if own:
        before = materialise(before, "before-sum").withColumnRenamed("_own", "sos")
        before = clipped(R.cascade(before, [*keys, "channel"]), "clip_before")
    summed = materialise(sum_blocks(before, keys), "bass-sum")
    after = low_passed(summed.join(config, keys).select(*keys, "block_no", "start_i", "fs", "samples", *settings), "After", keys)
    return clipped(after, "clip_after").select(*keys, "block_no", "start_i", "fs", "samples")


def high_pass_mains(blocks: DataFrame, keys: Sequence[str], freq: float) -> DataFrame:
    """Fourth-order high pass on every channel but LFE."""
    hp = fourth_order("HighPass2", F.col("fs"), F.lit(float(freq)))
    return R.cascade(blocks.withColumn("sos", F.when(is_lfe(F.col("channel")), no_filter(2)).otherwise(hp)), keys)


def mono_mix(samples: DataFrame) -> DataFrame:
    """One channel per title: fixed gains if the title has an LFE, else equal parts."""
    known = samples.select("title", "channel").distinct().groupBy("title").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(is_lfe(F.col("channel"))).alias("_lfe")
    )
    gain = (
        F.when(~F.col("_lfe"), 1.0 / F.col("_n"))
        .when(is_lfe(F.col("channel")), 10.0 ** (MONO_LFE_DB / 20.0))
        .otherwise(10.0 ** (MONO_MAIN_DB / 20.0))
    )
    return samples.join(known, "title").groupBy("title", "i").agg(F.sum(F.col("v") * gain).alias("v"))


def remix_bass(blocks: DataFrame, freq: float, keys: Sequence[str] = ("title",)) -> DataFrame:
    """Move the bass of the mains into the LFE: LFE gets itself and the low-passed
    mains, attenuated; the mains keep what is above the crossover."""
    keys = list(keys)
    lfe = is_lfe(F.col("channel"))
    part = F.explode(F.when(lfe, F.array(F.lit("lfe"))).otherwise(F.array(F.lit("low"), F.lit("high"))))
    both = blocks.withColumn("part", part)
    low = fourth_order("LowPass2", F.col("fs"), F.lit(float(freq)))
    high = fourth_order("HighPass2", F.col("fs"), F.lit(float(freq)))
    pick = F.when(F.col("part") == "low", low).when(F.col("part") == "high", high).otherwise(no_filter(2))
    out = R.cascade(both.withColumn("sos", pick), [*keys, "channel", "part"])
    scale = F.when(F.col("part") == "low", 10.0 ** (REMIX_MAIN_DB / 20.0)).when(
        F.col("part") == "lfe", 10.0 ** (REMIX_LFE_DB / 20.0)
    ).otherwise(1.0)
    out = out.withColumn("_g", scale).withColumn("samples", F.transform("samples", lambda v: v * F.col("_g")))
    out = out.withColumn("_to", F.when(F.col("part") == "high", F.col("channel")).otherwise(F.lit(LFE)))
    out = out.select(
        *keys, "_to", F.concat_ws("/", "part", "channel").alias("channel"), "block_no", "start_i", "fs", "samples"
    )
    return sum_blocks(out, [*keys, "_to"]).withColumnRenamed("_to", "channel")


def mix(samples: DataFrame, mode: str, source: str, target: str, gain_db: float = 0.0) -> DataFrame:
    """Mix one channel into another: add, subtract, copy, move (the source falls
    silent) or swap (both with the gain)."""
    g = 10.0 ** (gain_db / 20.0)
    rows = samples.select("title", "channel", "i", "v", "fs")
    is_source, is_target = F.col("channel") == source, F.col("channel") == target
    scaled = (F.col("v") * g).alias("v")
    if mode in ("add", "subtract"):
        sign = 1.0 if mode == "add" else -1.0
        sent = rows.where(is_source).select("title", F.lit(target).alias("channel"), "i", (F.col("v") * (g * sign)).alias("v"), "fs")
        mixed = rows.where(is_target).unionByName(sent).groupBy("title", "channel", "i").agg(F.sum("v").alias("v"), F.first("fs").alias("fs"))
        return rows.where(~is_target).unionByName(mixed)
    if mode in ("copy", "move"):
        sent = rows.where(is_source).select("title", F.lit(target).alias("channel"), "i", scaled, "fs")
        kept = rows.where(~is_target)
        if mode == "move":
            kept = kept.withColumn("v", F.when(is_source, 0.0).otherwise(F.col("v")))
        return kept.unionByName(sent)
    if mode == "swap":
        name = F.when(is_source, target).when(is_target, source).otherwise(F.col("channel"))
        value = F.when(is_source | is_target, F.col("v") * g).otherwise(F.col("v"))
        return rows.select("title", name.alias("channel"), "i", value.alias("v"), "fs")
    raise ValueError(f"unknown mix mode {mode}")


def apply_ops(samples: DataFrame, ops: Sequence[dict], keys: Sequence[str] = ("title", "channel")) -> DataFrame:
    """Run gain, delay, polarity and mute operations in order, each on its channels.

    An operation is {kind, channels, value, enabled}; a disabled one is skipped. The list is folded into one factor and
    one way per channel, so the samples are read no more often for more operations.
    """
    factor, by, low, high = F.lit(1.0), F.lit(0), F.lit(0), F.lit(0)
    delays = False
    for op in ops:
        if not op.get("enabled", True):
            continue
        on = F.col("channel").isin(*op["channels"])
        kind = op["kind"]
        if kind == "gain":
            factor = factor * F.when(on, 10.0 ** (op["value"] / 20.0)).otherwise(1.0)
        elif kind == "polarity":
            factor = factor * F.when(on, -1.0).otherwise(1.0)
        elif kind == "mute":
            factor = factor * F.when(on, 0.0).otherwise(1.0)
        elif kind == "delay":
            by = by + F.when(on, S.whole_samples(float(op["value"]))).otherwise(0)
            low, high, delays = F.least(low, by), F.greatest(high, by), True
        else:
            raise ValueError(f"unknown operation {kind}")
    out = samples.select(*keys, "i", "v", "fs")
    if delays:
        out = S.moved(with_group_agg(out, list(keys), _n=F.max("i") + 1), by, low, high)
    return out.withColumn("v", F.col("v") * factor)


def route(samples: DataFrame, routes: DataFrame, on: Sequence[str] = ("title",)) -> DataFrame:
    """Apply a routing table (title, i, w, o) to samples (title, ch, i, v): each output is the
    sum of the inputs routed to it, once per input whatever the number of ways."""
    pairs = routes.select(*on, F.col("i").alias("ch"), "o").distinct()
    # Dealt by sample before they are summed: groups are a few rows each, so sums begun in the tasks of the join would hold
    # nearly all of their rows.
    tasks = 4 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = samples.join(pairs, [*on, "ch"]).repartition(tasks, *on, "i")
    return dealt.groupBy(*on, "o", "i").agg(F.sum("v").alias("v"))


def sum_ways(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys, "i").agg(F.sum("v").alias("v"))


def gain_rows(channels: DataFrame, main_db: float, lfe_db: float) -> DataFrame:
    """The non-zero gain adjustment of each channel."""
    db = F.when(is_lfe(F.col("channel")), float(lfe_db)).otherwise(float(main_db))
    return channels.withColumn("gain_db", db).where(F.col("gain_db") != 0.0)


def normalise_delays(delays: DataFrame, keys: Sequence[str] = ("title",)) -> DataFrame:
    """(title, delay_ms, channels): delays against the longest, channels of equal
    delay together, none where nothing is left to delay."""
    keys = list(keys)
    longest = delays.groupBy(*keys).agg(F.max("delay_ms").alias("_max"))
    left = delays.join(longest, keys).withColumn("_d", F.round(F.col("_max") - F.col("delay_ms"), 6))
    left = left.where(F.abs("_d") > 1e-9)
    return left.groupBy(*keys, F.col("_d").alias("delay_ms")).agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def active_filters(signals: DataFrame, links: DataFrame) -> DataFrame:
    """Each signal's filter set: its master's if it is linked, else its own."""
    masters = signals.select(F.col("signal_id").alias("master"), F.col("filter_set_id").alias("_theirs"))
    out = signals.join(links.withColumnRenamed("slave", "signal_id"), "signal_id", "left").join(masters, "master", "left")
    return out.select("signal_id", "master", F.coalesce("_theirs", "filter_set_id").alias("active_set"))


def valid_links(links: DataFrame, signals: DataFrame) -> DataFrame:
    ids = signals.select("signal_id")
    out = links.join(ids.withColumnRenamed("signal_id", "master"), "master", "left_semi")
    return out.join(ids.withColumnRenamed("signal_id", "slave"), "slave", "left_semi").select("master", "slave")


def complete_groups(groups: DataFrame, signals: DataFrame) -> DataFrame:
    """Titles whose every channel signal (title, signal_id) is present."""
    found = groups.join(signals.select("signal_id", F.lit(1).alias("_here")), "signal_id", "left")
    counted = found.groupBy("title").agg(F.count(F.lit(1)).alias("expected"), F.count("_here").alias("present"))
    return counted.where(F.col("expected") == F.col("present")).select("title", "expected")


def match_channels(signals: DataFrame, channels: DataFrame) -> DataFrame:
    """Signals whose name ends in ``_<channel>`` with that channel's row."""
    named = signals.withColumn("channel", F.regexp_extract("name", "_([^_]+)$", 1))
    return named.join(channels, "channel")


def least_headroom(samples: DataFrame, keys: Sequence[str], over: Sequence[str]) -> DataFrame:
    """The smallest headroom of the filtered channels, never above zero."""
    each = stats.headroom(samples, keys)
    return each.groupBy(*over).agg(F.least(F.min("headroom_db"), F.lit(0.0)).alias("headroom_db"))
