"""Compositions a user runs end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.functions import levels
from lowtide.operators import recursive as R
from lowtide.operators import samples as S
from lowtide.operators import spectral as P
from lowtide.session import materialise


def filter_signal(
    blocks: DataFrame, keys: Sequence[str], gain: Column | float = 1.0, before: Column | None = None,
    active: Column | None = None, after: Column | None = None, clip: bool = False,
) -> DataFrame:
    """Gain, pre filter, clip, active filter, post filter, clip. Cascades with no
    clip between them run as one."""
    out = blocks.withColumn("_g", gain if isinstance(gain, Column) else F.lit(float(gain)))
    out = out.withColumn("samples", F.transform("samples", lambda v: v * F.col("_g"))).drop("_g")
    limit = lambda df: S.map_blocks(df, lambda v: levels.clip(v))
    groups = [[before], [active, after]] if clip else [[before, active, after]]
    for step, group in enumerate(groups):
        chain = [c for c in group if c is not None]
        if chain:
            if step:  # a cascade reads its input twice
                out = materialise(out, "stage")
            out = R.cascade(out.withColumn("sos", F.concat(*chain)), keys)
        if clip:
            out = limit(out)
    return out


def slice_spectrum(
    samples: DataFrame, keys: Sequence[str], start_s: float, end_s: float, nperseg: int | None = None
) -> DataFrame:
    """Mean spectrum of a time slice."""
    keys = list(keys)
    part = S.cut(samples, keys, start_s, end_s)
    firsts = part.groupBy(*keys).agg(F.min("i").alias("_first"), (F.max("i") - F.min("i") + 1).alias("n"))
    moved = part.join(firsts, keys).withColumn("i", F.col("i") - F.col("_first"))
    return P.avg_spectrum(S.to_blocks(moved, [*keys, "fs", "n"]), keys, nperseg=nperseg)


def filtered_spectrum(spark, search: str, response: DataFrame, target_fs: int = 1000) -> DataFrame:
    """Audio files to mean spectra with a filter's response added: (path, channel_no,
    f, db, filtered_db). The converted audio is stored once; ``response`` is one
    curve (f, db)."""
    from lowtide.operators import curves as C
    from lowtide.operators.resample import resample_all
    from lowtide.sources.wav import read_wav

    keys = ["path", "channel_no"]
    blocks = read_wav(spark, search)
    stored = materialise(resample_all(blocks, keys, target_fs), "converted")
    curve = P.avg_spectrum(stored, keys)
    # The response is read once, at the frequencies that occur: those of the few grids of one target rate.
    one = lambda df: df.withColumn("_one", F.lit(0))
    bent = C.interpolate(one(response.select("f", "db")), one(curve.select("f").distinct()), ["_one"])
    return curve.select(*keys, "f", "db").join(bent.select("f", F.col("db").alias("_add")), "f").select(
        *keys, "f", "db", (F.col("db") + F.col("_add")).alias("filtered_db")
    )


def bass_managed(
    blocks: DataFrame, config: DataFrame, signals: DataFrame, links: DataFrame, cascades: dict[str, Column]
) -> DataFrame:
    """Bass-managed output of every title with each channel under its active filter.

    ``signals`` has (signal_id, filter_set_id) with ids ``title/channel``; a linked
    channel takes its master's set. ``cascades`` are the flat sections of each set.
    """
    from lowtide.operators import channels as M

    active = M.active_filters(signals, links).select("signal_id", "active_set")
    named = blocks.withColumn("signal_id", F.concat_ws("/", F.col("title").cast("string"), "channel"))
    sos = M.no_filter()
    for name, sections in cascades.items():
        sos = F.when(F.col("active_set") == name, sections).otherwise(sos)
    ready = named.join(active, "signal_id").withColumn("sos", sos).drop("signal_id", "active_set")
    return M.bass_manage(ready, config)
