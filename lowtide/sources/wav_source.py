"""Audio files as a Spark data source: byte ranges are the partitions, filters on path, channel and place are pushed."""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from lowtide.sources.files import open_range, reader, store
from lowtide.sources.wav import BLOCKS, decode, walk_header

FORMAT = "wav_blocks"
PARTITION_BYTES = 32 << 20
READ_BYTES = 4 << 20
UNKNOWN = 0xFFFFFFFF  # size of samples that were written to a pipe
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def listed(search: str) -> list[tuple[str, int]]:
    """(path, length) of the files under a folder, or that match a glob; names and sizes only. A glob without a match is an
    error, as it is to Spark's own readers."""
    head = search.split("*")[0].split("?")[0].split("[")[0]
    files, root = store(search if head == search else head.rsplit("/", 1)[0])
    prefix = search[: len(search) - len(store(search)[1])] if "://" in search or search.startswith("file:") else ""
    info = files.get_file_info(root)
    if info.type == arrow_fs.FileType.File:
        return [(prefix + info.path, info.size)]
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(search)
    found = files.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    pattern = store(search)[1] if head != search else f"{root.rstrip('/')}/*"
    out = sorted((prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and fnmatch.fnmatch(f.path, pattern))
    if not out and head != search:
        raise FileNotFoundError(search)
    return out


@dataclass
class Ranges(InputPartition):
    """(path, length, first byte, byte after the last) of the parts of files that one task reads."""

    parts: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    """What is pushed is applied before a byte of samples is read: paths when files are planned, channels and places when
    a range is read. Spark tests places once more, block by block.

    What the store refuses, or gives only in part, ends the job. A file that is no audio that can be read is left out, or
    ends the job with the option ``failOnRejects``, as does one that ends before its samples do."""

    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}  # as Spark hands them over
        self.search = options["path"]
        self.block = int(options.get("block", 4096))
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.strict = str(options.get("failonrejects", "false")).lower() == "true"
        self.paths: list[tuple[str, object]] = []
        self.channels: list[set[int]] = []
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.paths.append((type(f).__name__, f.value))
            elif column == ("channel_no",) and isinstance(f, (EqualTo, In)):
                self.channels.append({f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                if column == ("start_i",):
                    self._place(f)
                yield f

    def _place(self, f: Filter) -> None:
        v = getattr(f, "value", None)
        if isinstance(f, In):
            low, high = min(f.value), max(f.value) + 1
        elif isinstance(f, EqualTo):
            low, high = v, v + 1
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low, high = v + isinstance(f, GreaterThan), None
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            low, high = 0, v + isinstance(f, LessThanOrEqual)
        else:
            return
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def _wanted(self, path: str) -> bool:
        tests = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": lambda v: path.startswith(v)}
        return all(tests[kind](value) for kind, value in self.paths)

    def partitions(self) -> list[Ranges]:
        out, parts, size = [], [], 0
        for path, length in listed(self.search):
            if not self._wanted(path):
                continue
            for first in range(0, length, self.size):
                last = min(first + self.size, length)
                parts.append((path, length, first, last))
                size += last - first
                if size >= self.size:
                    out.append(Ranges(parts))
                    parts, size = [], 0
        return [*out, Ranges(parts)] if parts or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, length, first, last in partition.parts:
            read = reader(path)
            try:
                fs, channels, bits, is_float, data_at, size = walk_header(read, length)
                if self.strict and length - data_at < size != UNKNOWN:
                    raise ValueError(f"{length - data_at} of {size} bytes of samples")
            except (ValueError, struct.error) as error:
                if self.strict:
                    raise ValueError(f"{path}: {error}") from error
                continue  # a row of ``rejected_wav``
            finally:
                read.close()
            width = channels * bits // 8
            n = min(size, length - data_at) // width
            step = self.block * width
            chosen = [c for c in range(channels) if all(c in s for s in self.channels)]
            # The blocks whose first byte is in the range and whose place may be wanted.
            a = max(-(-(first - data_at) // step), self.low // self.block, 0)
            b = min(-(-(last - data_at) // step), -(-n // self.block))
            if self.high is not None:
                b = min(b, -(-self.high // self.block))
            each = max(1, READ_BYTES // step)
            for k in range(a, b if chosen else a, each):
                end = min(k + each, b)
                frames = min(end * self.block, n) - k * self.block
                raw = open_range(path, data_at + k * step, frames * width)
                if len(raw) < frames * width:
                    raise OSError(f"{path}: {len(raw)} of {frames * width} bytes from {data_at + k * step} on")
                x = decode(raw, channels, bits, is_float)
                rows = [(c, k + j, x[j * self.block : (j + 1) * self.block, c]) for j in range(end - k) for c in chosen]
                count = len(rows)
                samples = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *[len(r[2]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]), pa.float64())
                )
                numbers = np.array([r[1] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * count), pa.array([r[0] for r in rows], pa.int32()), pa.array([channels] * count, pa.int32()),
                        pa.array([fs] * count, pa.int32()),
                        pa.array([n] * count, pa.int64()), pa.array(numbers), pa.array(numbers * self.block), samples,
                    ],
                    ["path", "channel_no", "channels", "fs", "n", "block_no", "start_i", "samples"],
                )


class WavBlocks(DataSource):
    """``spark.read.format("wav_blocks").option("block", 4096).load(folder or glob)``; columns as ``read_wav`` has them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))


def wav_blocks(
    spark: SparkSession, search: str, block: int = 4096, partition_bytes: int = PARTITION_BYTES, fail_on_rejects: bool = False
) -> DataFrame:
    """Blocks of every channel of every file; filters on ``path``, ``channel_no`` and ``start_i`` reach the reader. For that
    the session's ``spark.sql.python.filterPushdown.enabled`` is switched on, as Spark wants it for such readers.

    A search that finds nothing and a file that the store does not give whole are errors. Files that are no audio are left
    out, as by ``read_wav``, and listed by ``rejected_wav``; with ``fail_on_rejects`` they, and files cut short, are errors
    too."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WavBlocks)
    return spark.read.format(FORMAT).option("block", block).option("partitionBytes", partition_bytes).option("failOnRejects", fail_on_rejects).load(search)
