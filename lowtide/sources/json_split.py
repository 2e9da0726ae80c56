"""Elements of large JSON arrays, without a cell or a task that holds a file.

A plain file is read in byte ranges by many tasks. Where a range begins, inside a string or not and how deep, follows
from the ranges before: each range tells what it does to either state, and one row per range is composed in order. A
gzip file is one stream; it is inflated and cut step by step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.sources.files import find_files, reader

RANGE_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
ELEMENTS = "path string, at long, content string"
SUMMARY = "path string, part long, first long, last long, ends array<boolean>, depth array<long>, commas array<map<long,long>>, some array<boolean>"
STARTS = "path string, first long, last long, inside boolean, depth long, at long"

_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1
_MARKS = _STEP != 0
_MARKS[ord(",")] = True


def unescaped_quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Where quotes begin or end a string, and whether the byte after the data is escaped. ``escaped`` says so of the
    first one. After an odd number of backslashes a byte is escaped."""
    quotes, back = np.flatnonzero(data == 34), np.flatnonzero(data == 92)
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    if escaped and len(back) and back[0] == 0:
        back = back[1:]
    if not len(back):
        return quotes, escaped and not len(data)
    ends = np.flatnonzero(np.diff(back, append=back[-1] + 2) != 1)
    odd = np.diff(ends, prepend=-1) % 2 == 1
    after = back[ends[odd]] + 1
    return quotes[~np.isin(quotes, after, assume_unique=True)], bool(len(after) and after[-1] == len(data))


def marks(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(places, steps, inside, escaped): brackets (1 or -1) and commas (0) outside of strings, and the state behind."""
    a = np.frombuffer(data, np.uint8)
    quotes, escaped = unescaped_quotes(a, escaped)
    at = np.flatnonzero(_MARKS[a])
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    at = at[outside]
    return at, _STEP[a[at]].astype(np.int64), bool((len(quotes) + inside) % 2), escaped


class ElementCutter:
    """Cuts a stream of bytes, from a known state on, into the elements of the array that it belongs to.

    An element is told once its end has been read; only elements that begin before ``last`` are. What is in memory is
    the element being read and one chunk.
    """

    def __init__(self, first: int = 0, last: float = float("inf"), inside: bool = False, escaped: bool = False, depth: int = 0):
        self.at, self.last = first, last
        self.inside, self.escaped, self.depth = inside, escaped, depth
        self.begun: list[bytes] | None = None
        self.done = False

    def feed(self, data: bytes) -> Iterator[bytes]:
        places, steps, self.inside, self.escaped = marks(data, self.inside, self.escaped)
        depth = self.depth + np.cumsum(steps)
        # Ends of elements: commas at depth 1 and the bracket that leads to 0; its opening leads to 1 from 0.
        edge = np.flatnonzero(((steps == 0) & (depth == 1)) | ((steps < 0) & (depth == 0)) | ((steps > 0) & (depth == 1)))
        start = 0
        for p, step in zip(places[edge].tolist(), steps[edge].tolist()):
            if self.begun is not None and step <= 0:
                self.begun.append(data[start:p])
                element = b"".join(self.begun)
                self.begun = None
                if element.strip():
                    yield element
            if step < 0 or self.at + p >= self.last:
                self.done = True
                break
            self.begun, start = [], p + 1
        if self.begun is not None:
            self.begun.append(data[start:])
        self.depth += int(steps.sum())
        self.at += len(data)
        self.done |= self.begun is None and self.at >= self.last


def elements(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The elements of one JSON array that comes in chunks; a text that is no array is one element."""
    cutter, whole = None, []
    for data in chunks:
        if cutter is None:
            head = data.lstrip()
            if not head:
                continue
            cutter = ElementCutter() if head[:1] == b"[" else False
        if cutter:
            yield from cutter.feed(data)
            if cutter.done:
                return
        else:
            whole.append(data)
    if whole:
        yield b"".join(whole)


def inflated(read: Callable[[int, int], bytes], chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The content of a gzip file of one or more members in pieces of at most ``chunk`` bytes; another file as it is."""
    at, stream, data = 0, None, read(0, chunk)
    zipped = data[:2] == b"\x1f\x8b"
    while data:
        at += len(data)
        while zipped and data:
            stream = stream or zlib.decompressobj(31)
            out = stream.decompress(data, chunk)
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data.lstrip(b"\0"), None
        if not zipped:
            yield data
        data = read(at, chunk)
    if stream is not None:
        tail = stream.flush()
        if tail:
            yield tail
        if not stream.eof:
            raise ValueError("the gzip stream ends early")


def _array_head(read: Callable[[int, int], bytes], length: int) -> bool:
    at = 0
    while at < length:
        head = read(at, 4096).lstrip()
        if head:
            return head[:1] == b"["
        at += 4096
    return False


def _escaped_at(read: Callable[[int, int], bytes], first: int) -> bool:
    """Whether an odd number of backslashes stands before a place, however long their run."""
    run, at = 0, first
    while at > 0:
        size = min(4096, at)
        part = read(at - size, size)
        tail = len(part) - len(part.rstrip(b"\\"))
        run, at = run + tail, at - size
        if tail < size:
            break
    return run % 2 == 1


def _chunks(read: Callable[[int, int], bytes], first: int, last: int) -> Iterator[bytes]:
    for at in range(first, last, CHUNK_BYTES):
        yield read(at, min(CHUNK_BYTES, last - at))


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range does to a state outside and one inside a string: the state behind it, the change of depth, its
    commas by relative depth and whether it has a bracket or comma at all."""
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            read = reader(r.path)
            try:
                escaped = _escaped_at(read, r.first)
                state, depth = [False, True], [0, 0]
                commas: list[dict[int, int]] = [{}, {}]
                some = [False, False]
                for data in _chunks(read, r.first, r.last):
                    for k in (0, 1):
                        _, steps, state[k], after = marks(data, state[k], escaped)
                        depths = depth[k] + np.cumsum(steps)
                        for d, n in zip(*np.unique(depths[steps == 0], return_counts=True)):
                            commas[k][int(d)] = commas[k].get(int(d), 0) + int(n)
                        depth[k] += int(steps.sum())
                        some[k] |= bool(len(steps))
                    escaped = after
            finally:
                read.close()
            rows.append((r.path, r.part, r.first, r.last, state, depth, commas, some))
        yield pd.DataFrame(rows, columns=["path", "part", "first", "last", "ends", "depth", "commas", "some"])


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of a file, and the number of the first element that begins in it."""
    rows, inside, depth, at, opened = [], False, 0, 0, False
    for r in pdf.sort_values("part").itertuples(index=False):
        rows.append((r.path, r.first, r.last, inside, depth, at))
        k = int(inside)
        at += dict(r.commas[k]).get(1 - depth, 0)
        if not opened and r.some[k]:
            at, opened = at + 1, True
        depth += r.depth[k]
        inside = bool(r.ends[k])
    return pd.DataFrame(rows, columns=["path", "first", "last", "inside", "depth", "at"])


def _batches(rows: Iterable[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    paths, places, contents, size = [], [], [], 0

    def batch() -> pa.RecordBatch:
        texts = pa.array(contents, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int64()), texts], ["path", "at", "content"])

    for path, at, content in rows:
        paths.append(path)
        places.append(at)
        contents.append(content)
        size += len(content)
        if size > BATCH_BYTES:
            yield batch()
            paths, places, contents, size = [], [], [], 0
    yield batch()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for path, length, first, last, inside, depth, at in zip(*[c.to_pylist() for c in batch.columns]):
                read = reader(path)
                try:
                    if not _array_head(read, length):
                        if first == 0:
                            yield path, 0, b"".join(_chunks(read, 0, length))
                        continue
                    cutter = ElementCutter(first, last, inside, _escaped_at(read, first), depth)
                    for data in _chunks(read, first, length):
                        for element in cutter.feed(data):
                            yield path, at, element
                            at += 1
                        if cutter.done:
                            break
                finally:
                    read.close()

    yield from _batches(rows())


def json_elements(spark: SparkSession, search: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, content): the elements of the JSON array in each plain file, numbered from 0, or the file's one object.

    Files are cut into ranges of ``range_bytes``. A first pass reads each range once and describes it by a few numbers;
    these are composed per file, one row a range; a second pass reads each range again and on to the end of the last
    element that begins in it. An array that is cut off loses its last element; empty files and arrays have no rows.
    """
    files = find_files(spark, search).where("length > 0").select("path", "length")
    parts = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    parts = parts.select("path", (F.col("first") / range_bytes).cast("long").alias("part"), "first", F.least(F.col("first") + range_bytes, "length").alias("last"))
    told = parts.repartition("path", "part").mapInPandas(_summaries, SUMMARY)
    starts = told.groupBy("path").applyInPandas(_composed, STARTS)
    known = starts.join(files, "path").select("path", "length", "first", "last", "inside", "depth", "at")
    return known.repartition("path", "first").mapInArrow(_cut, ELEMENTS)


def gzip_elements(spark: SparkSession, search: str) -> DataFrame:
    """(path, at, content) as ``json_elements`` has them, of gzip files whatever their extension, and of plain ones.

    A gzip file can only be read from its start, by one task; it is inflated piece by piece, and an element goes on as
    soon as its end has been read, so memory holds one element and one batch of at most BATCH_BYTES and an element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, bytes]]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    read = reader(path)
                    try:
                        for at, element in enumerate(elements(inflated(read))):
                            yield path, at, element
                    finally:
                        read.close()

        yield from _batches(rows())

    return find_files(spark, search).select("path").repartition("path").mapInArrow(run, ELEMENTS)
