"""Registered queries on audio files, which are first made from the samples."""

from __future__ import annotations

import math
import struct
import uuid

import numpy as np
from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import channels as M
from lowtide.operators import samples as S
from lowtide.plans.registry import query
from lowtide.plans.spectral_queries import CONVERTED
from lowtide.plans.tables import sample_blocks, sql_with
from lowtide.session import shared_dir
from lowtide.sources import wav as A
from lowtide.sources.files import find_files, put_file, stem
from lowtide.sources.wav_source import wav_blocks

FRAMES = 64


def _write(folder: str):
    def write(frames):
        for frame in frames:
            for name, block, fs, x in zip(frame["signal_id"], frame["block_no"], frame["fs"], frame["samples"]):
                left = np.floor(np.asarray(x) * 32768.0)
                raw = np.clip(np.stack([left, -left], axis=1), -32768, 32767).astype("<i2").tobytes()
                head = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt "
                head += struct.pack("<IHHIIHH", 16, 1, 2, fs, fs * 4, 4, 16) + b"data" + struct.pack("<I", len(raw))
                put_file(f"{folder}/{name}_{block}.wav", head + raw)
            yield frame[["signal_id"]]

    return write


_FOLDERS: dict[tuple, str] = {}


def audio_folder(spark, sf) -> str:
    """A two-channel 16-bit file per stored block, the second channel inverted; samples beyond full scale are clipped."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDERS:
        folder = f"{shared_dir(spark)}/audio-{uuid.uuid4().hex}"
        sample_blocks(spark, sf, FRAMES).mapInPandas(_write(folder), "signal_id string").write.format("noop").mode("overwrite").save()
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _series(blocks):
    name = F.split(stem(F.col("path")), "_")
    rows = S.from_blocks(blocks, ["path", "channel_no"])
    return rows.select(name[0].alias("signal_id"), name[1].cast("long").alias("block"), "channel_no", "i", "v")


FILES = sql_with("samples", extra=f"""au as (select signal_id, i // {FRAMES} as block, i % {FRAMES} as i, c as channel_no,
 greatest(least((1 - 2*c)*floor(v*32768), 32767), -32768)/32768.0::double + 0.0 as v from samples, (select unnest([0, 1]) as c))""")


@query("read_wav", FILES + "select signal_id, cast(block as bigint) as block, channel_no, cast(i as bigint) as i, v from au")
def read_wav(spark, sf):
    return _series(A.read_wav(spark, f"{audio_folder(spark, sf)}/*.wav", block=16)).withColumn("v", F.col("v") + 0.0)


@query("read_wav_range", FILES + "select signal_id, cast(block as bigint) as block, channel_no, cast(i - 6 as bigint) as i, v from au where i >= 6 and i < 38")
def read_wav_range(spark, sf):
    return _series(A.read_wav(spark, f"{audio_folder(spark, sf)}/*.wav", 100, 600)).withColumn("v", F.col("v") + 0.0)


@query("read_wav_source", FILES + """select signal_id, cast(block as bigint) as block, channel_no, cast(i as bigint) as i, v from au where i >= 16 and i < 48 and channel_no = 1""")
def read_wav_source(spark, sf):
    """A range of one channel through the data source: the filters reach its reader. All files were written here, so one
    that cannot be read is an error."""
    blocks = wav_blocks(spark, audio_folder(spark, sf), block=16, fail_on_rejects=True).where("start_i between 16 and 32 and channel_no = 1")
    name = F.split(stem(F.col("path")), "_")
    rows = blocks.select(name[0].alias("signal_id"), name[1].cast("long").alias("block"), "channel_no", "start_i", F.posexplode("samples").alias("k", "x"))
    return rows.select("signal_id", "block", "channel_no", (F.col("start_i") + F.col("k")).alias("i"), (F.col("x") + 0.0).alias("v"))


@query("load_channel", FILES + "select signal_id, cast(block as bigint) as block, channel_no, cast(i as bigint) as i, round(v*pow(10.0::double, -6.0::double/20), 9) + 0.0 as v from au where channel_no = 1")
def load_channel(spark, sf):
    out = A.load_channel(spark, f"{audio_folder(spark, sf)}/*.wav", channel=2, target_fs=None, offset_db=-6.0)
    return _series(out).withColumn("v", rounded(F.col("v"), 9))


LOADED = ", long as (select signal_id || '_' || block as signal_id, i, v*0.5::double as v from au where channel_no = 1)"


# The kernel from 64 to 16 Hz and its sums, as the rate conversion states them.
@query("load_channel_resampled", FILES + LOADED + CONVERTED)
def load_channel_resampled(spark, sf):
    """One channel of every file at a lower rate, then at half its level."""
    out = A.load_channel(spark, f"{audio_folder(spark, sf)}/*.wav", channel=2, target_fs=16, offset_db=20 * math.log10(0.5))
    rows = S.from_blocks(out, ["path"])
    return rows.select(stem(F.col("path")).alias("signal_id"), "i", rounded(F.col("v"), 8).alias("v"))


def _composite_config(files):
    return files.select(
        stem(F.col("path")).alias("title"), F.lit(20.0).alias("lpf_hz"), F.lit("Off").alias("lpf_position"), F.lit("WCS").alias("headroom_type"),
        F.lit(False).alias("clip_before"), F.lit(True).alias("clip_after"),
    )


@query("load_composite", FILES + """select signal_id || '_' || block as title, 2 as channel_count, cast(i as bigint) as i,
 round(greatest(least(sum(v*case channel_no when 0 then 6.0::double else 1.0 end)/(1 + sqrt(10.0::double)), 1), -1), 8) + 0.0 as v from au group by all""")
def load_composite(spark, sf):
    """The bass-managed composite of every multichannel file, its left channel louder."""
    named, composite = A.load_signals(spark, f"{audio_folder(spark, sf)}/*.wav")
    louder = F.when(F.col("channel_no") == 0, F.transform("samples", lambda v: v * 6.0)).otherwise(F.col("samples"))
    blocks = named.select(stem(F.col("path")).alias("title"), F.col("name").alias("channel"), "block_no", "start_i", "fs", louder.alias("samples"))
    files = composite.select(stem(F.col("path")).alias("title"), "channel_count")
    out = S.from_blocks(M.bass_manage(blocks, _composite_config(composite)), ["title"]).join(files, "title")
    return out.select("title", F.col("channel_count").cast("int").alias("channel_count"), "i", (rounded(F.col("v"), 8) + 0.0).alias("v"))


@query("load_signals", FILES + "select signal_id || '_' || block || case channel_no when 0 then '_FL' else '_FR' end as name, count(*) as frames from au group by all")
def load_signals(spark, sf):
    named, _ = A.load_signals(spark, f"{audio_folder(spark, sf)}/*.wav")
    return named.groupBy("name").agg(F.sum(F.size("samples")).alias("frames"))


@query("find_files", FILES + "select signal_id || '_' || block as name, count(*)*2 + 44 as length from au where signal_id like 's0000%' or block = 0 group by all")
def find_audio_files(spark, sf):
    folder = audio_folder(spark, sf)
    return find_files(spark, f"{folder}/s0000*.wav; {folder}/*_0.wav").select(stem(F.col("path")).alias("name"), "length")
