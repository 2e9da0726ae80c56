"""Registered queries on stored blocks: the same results as those on rows, without taking blocks apart before the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import blocks as B
from lowtide.operators import pyramid as P
from lowtide.operators import samples as S
from lowtide.plans import signal_queries  # noqa: F401  its SQL is stated here again
from lowtide.plans.channel_queries import KEYS, channel_blocks, title_routes
from lowtide.plans.registry import ORACLES, query
from lowtide.plans.tables import _stored, sample_blocks, sql_with

BLOCK = 64


def _signals(spark, sf):
    return sample_blocks(spark, sf, BLOCK)


def _rows(blocks, *keys):
    return S.from_blocks(blocks, list(keys))


@query("cut_on_blocks", ORACLES["cut"])
def cut_on_blocks(spark, sf):
    return _rows(B.cut(_signals(spark, sf), ["signal_id"], 0.2, 1.0), "signal_id")


@query("delay_on_blocks", ORACLES["delay"])
def delay_on_blocks(spark, sf):
    return _rows(B.shift(_signals(spark, sf), ["signal_id"], 200.0, BLOCK), "signal_id")


@query("advance_on_blocks", ORACLES["advance"])
def advance_on_blocks(spark, sf):
    return _rows(B.shift(_signals(spark, sf), ["signal_id"], -330.0, BLOCK), "signal_id")


@query("concatenate_on_blocks", ORACLES["concatenate"])
def concatenate_on_blocks(spark, sf):
    order = {c: k for k, c in enumerate(("FL", "FR", "FC", "LFE", "BL", "BR"))}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("channel"))
    blocks = channel_blocks(spark, sf).withColumn("part", F.concat_ws("/", "title", "channel"))
    plan = blocks.where("start_i = 0").select("part", F.col("title").alias("merged_id"), number.alias("ord"))
    joined = B.concatenate(blocks.select("part", "fs", "block_no", "start_i", "samples"), "part", plan, block=BLOCK)
    return _rows(joined, "merged_id", "fs")


def _pyramid(spark, sf):
    """The blocks of all signals with their energies and peaks, stored once as a user keeps them."""
    return _stored(spark, sf, "pyramid", lambda: P.with_pyramid(_signals(spark, sf)))


@query("windowed_peaks_on_blocks", ORACLES["windowed_peaks"])
def windowed_peaks_on_blocks(spark, sf):
    return P.windowed_peaks(_pyramid(spark, sf), ["signal_id"]).withColumn("db", rounded(F.col("db")))


@query("level_report_on_blocks", ORACLES["level_report"])
def level_report_on_blocks(spark, sf):
    out = P.levels(_pyramid(spark, sf), ["signal_id"])
    return out.select("signal_id", *[rounded(F.col(c)).alias(c) for c in out.columns if c != "signal_id"])


@query("range_levels", sql_with("samples") + """, r as (select signal_id, k*7 as low, k*7 + 5 + k*40 as high from (select distinct signal_id from samples), (select unnest(range(8)) as k))
select signal_id, low, high, round(10*log10(avg(v*v)), 6) as rms_db, round(20*log10(max(abs(v))), 6) as peak_db from r join samples using (signal_id) where i >= low and i < high group by all""")
def range_levels(spark, sf):
    """Eight stretches of every signal, across blocks and beyond its end."""
    blocks = _pyramid(spark, sf)
    k = F.col("k")
    ranges = blocks.where("start_i = 0").select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    out = P.range_levels(blocks, ranges.select("signal_id", (k * 7).alias("low"), (k * 47 + 5).alias("high")), ["signal_id"], BLOCK)
    return out.withColumns({c: rounded(F.col(c)) for c in ("rms_db", "peak_db")})


def _out(blocks, *keys):
    return _rows(blocks, *keys).withColumn("v", rounded(F.col("v"), 8))


@query("mono_mix_on_blocks", ORACLES["mono_mix"])
def mono_mix_on_blocks(spark, sf):
    return _out(B.mono_mix(channel_blocks(spark, sf)), "title")


def _mixed(mode):
    @query(f"mix_{mode}_on_blocks", ORACLES[f"mix_{mode}"])
    def run(spark, sf):
        return _out(B.mix(channel_blocks(spark, sf), mode, "FC", "FL", -3.0), *KEYS)

    return run


MIXES = [_mixed(mode) for mode in ("add", "subtract", "copy", "move", "swap")]


@query("routed_blocks", ORACLES["routed_samples"])
def routed_blocks(spark, sf):
    number = F.array_position(F.array(*[F.lit(c) for c in ("FL", "FR", "FC", "LFE", "BL", "BR")]), F.col("channel")).cast("int") - 1
    blocks = channel_blocks(spark, sf).withColumn("ch", number)
    return _out(B.route(blocks, title_routes(spark, sf)), "title", "o")
