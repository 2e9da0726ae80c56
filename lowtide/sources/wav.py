"""PCM audio to blocks.

A file is listed, its header is read, and its frames are read by many tasks, each
its own byte range: a long track is never held by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.functions.tables import LAYOUT_BY_COUNT, layout_table
from lowtide.sources.files import find_files, open_range, reader

RANGE_FRAMES = 1 << 18
HEADER = "path string, fs int, channels int, bits int, is_float boolean, data_at long, n long, error string"
BLOCKS = "path string, channel_no int, channels int, fs int, n long, block_no long, start_i long, samples array<double>"


def walk_header(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int, bool, int, int]:
    """(fs, channels, bits, is_float, data offset, data bytes) of a RIFF or RF64 WAVE file.

    Chunk heads are read one by one and their bodies are stepped over, so the samples may stand anywhere. Sizes beyond
    32 bits come from the ds64 chunk.
    """
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt, long_data = 12, None, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long_data = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            body = read(at + 8, min(size, 40))
            code, channels, fs, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if code == 0xFFFE:
                code = struct.unpack("<H", body[24:26])[0]
            if code not in (1, 3):
                raise ValueError(f"unsupported encoding {code}")
            if not channels or bits not in (8, 16, 24, 32, 64):
                raise ValueError(f"unsupported layout of {channels} channels of {bits} bits")
            fmt = (fs, channels, bits, code == 3)
        elif name == b"data":
            if fmt is None:
                raise ValueError("samples before their format")
            return (*fmt, at + 8, long_data if size == 0xFFFFFFFF and long_data is not None else size)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def parse_header(head: bytes) -> tuple[int, int, int, bool, int, int]:
    """``walk_header`` of a file that is at hand as bytes."""
    return walk_header(lambda at, size: head[at:at + size], len(head))


def decode(raw: bytes, channels: int, bits: int, is_float: bool) -> np.ndarray:
    """Interleaved little-endian samples to (frames, channels) in -1..1."""
    if is_float:
        x = np.frombuffer(raw, dtype=f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(float) - 128.0) / 128.0
    elif bits == 24:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / float(1 << 23)
    else:
        x = np.frombuffer(raw, dtype=f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))
    return x.reshape(-1, channels)


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, length in zip(frame["path"], frame["length"]):
            try:
                read = reader(path)
                try:
                    fs, channels, bits, is_float, at, size = walk_header(read, int(length))
                finally:
                    read.close()
                size = min(size, int(length) - at)
                rows.append((path, fs, channels, bits, is_float, at, size // (channels * bits // 8), None))
            except (OSError, ValueError, struct.error) as error:  # one bad file does not end the scan of a library
                rows.append((path, 0, 0, 0, False, 0, 0, str(error) or type(error).__name__))
        yield pd.DataFrame(rows, columns=["path", "fs", "channels", "bits", "is_float", "data_at", "n", "error"])


def headers(spark: SparkSession, search: str) -> DataFrame:
    """A row per file; ``error`` is null where it can be read."""
    return find_files(spark, search).select("path", "length").mapInPandas(_headers, HEADER)


def rejected_wav(spark: SparkSession, search: str) -> DataFrame:
    """(path, error) of the files that ``read_wav`` leaves out."""
    return headers(spark, search).where("error IS NOT NULL").select("path", "error")


def _ranges(block: int, channel: int | None):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                width = r.channels * r.bits // 8
                raw = open_range(r.path, int(r.data_at + r.first * width), int((r.last - r.first) * width))
                x = decode(raw, r.channels, r.bits, r.is_float)
                rows = []
                for at in range(0, len(x), block):
                    start = int(r.first - r.origin) + at
                    for c in range(r.channels) if channel is None else [channel]:
                        rows.append((r.path, c, r.channels, r.fs, r.total, start // block, start, x[at:at + block, c]))
                yield pd.DataFrame(
                    rows, columns=["path", "channel_no", "channels", "fs", "n", "block_no", "start_i", "samples"]
                )

    return read


def read_wav(
    spark: SparkSession, search: str, start_ms: int | None = None, end_ms: int | None = None, block: int = 4096,
    channel: int | None = None,
) -> DataFrame:
    """Blocks of every channel of every file, or of the one counted from 0; ``n`` is the length in frames and
    ``channels`` the file's number of channels. The time
    range is half-open and is applied before any sample is read. Files that cannot be read, and those without the
    channel, are left out (see ``rejected_wav``)."""
    heads = headers(spark, search).where("error IS NULL")
    if channel is not None:
        heads = heads.where(F.col("channels") > channel)
    frame = lambda ms: F.floor(F.lit(ms) * F.col("fs") / 1000.0).cast("long")
    begin = F.lit(0).cast("long") if start_ms is None else F.least(frame(start_ms), F.col("n"))
    end = F.col("n") if end_ms is None else F.least(frame(end_ms), F.col("n"))
    step = max(block, RANGE_FRAMES // block * block)
    parts = heads.withColumn("origin", begin).withColumn("total", end - begin).where("total > 0")
    parts = parts.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(step).cast("long"))))
    parts = parts.withColumn("first", F.col("origin") + F.col("_o")).withColumn(
        "last", F.least(F.col("origin") + F.col("_o") + step, F.col("origin") + F.col("total"))
    )
    # Numbered parts: a range is a short row but long work, and adaptive execution would join parts by their bytes.
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.drop("_o").repartition(tasks, "path", "first")
    return spread.mapInPandas(_ranges(block, channel), BLOCKS)


def channel_name(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Add ``name`` to rows of (text, channel_no, channel_count, layout): the bare text
    for mono, else text_channel by layout, by count for an unknown layout, else c1, c2."""
    by_count: Column = F.lit(None).cast("string")
    for count, layout in LAYOUT_BY_COUNT.items():
        by_count = F.when(F.col("channel_count") == count, layout).otherwise(by_count)
    known = rows.withColumn("_layout", F.when(F.col("layout") == "unknown", by_count).otherwise(F.col("layout")))
    names = F.broadcast(layout_table(spark).withColumnsRenamed({"layout": "_layout", "channel": "_channel"}))
    named = known.join(names, ["_layout", "channel_no"], "left")
    part = F.coalesce("_channel", F.concat(F.lit("c"), (F.col("channel_no") + 1).cast("string")))
    prefix = F.when(F.col("text").isNull(), "").otherwise(F.concat("text", F.lit("_")))
    name = F.when(F.col("channel_count") == 1, F.col("text")).otherwise(F.concat(prefix, part))
    return named.withColumn("name", name).drop("_layout", "_channel")


def load_signals(spark: SparkSession, search: str, layout: str = "unknown", **how) -> tuple[DataFrame, DataFrame]:
    """All channels of all files as named blocks, and a bass-management row (path,
    channel_count) for every file with samples of more than one channel. Headers are read once: blocks carry the count."""
    from lowtide.sources.files import stem

    blocks = read_wav(spark, search, **how).withColumnRenamed("channels", "channel_count")
    named = channel_name(spark, blocks.withColumn("text", stem(F.col("path"))).withColumn("layout", F.lit(layout)))
    first = blocks.where("block_no = 0 AND channel_no = 0 AND channel_count > 1")
    return named, first.select("path", "channel_count")


def load_channel(
    spark: SparkSession, search: str, channel: int = 1, target_fs: int | None = 1000, offset_db: float = 0.0, **how
) -> DataFrame:
    """One channel (counted from 1), converted to ``target_fs`` and then offset."""
    from lowtide.functions.levels import gain_ratio
    from lowtide.operators.resample import resample_all
    from lowtide.operators.samples import map_blocks

    out = read_wav(spark, search, channel=channel - 1, **how)
    if target_fs:
        out = resample_all(out, ["path", "channel_no"], target_fs)
    if abs(offset_db) > 1e-9:
        out = map_blocks(out, lambda v: v * gain_ratio(offset_db))
    return out
