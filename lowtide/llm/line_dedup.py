"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.columns import keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, text_bytes
from lowtide.session import materialise

#: Bytes of a line's identifier, and lines beyond a neighbouring chunk that are compared with it.
ID = 16
BEYOND = 2
BATCH_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lines(data: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that are not blank, trimmed, and their places among all lines."""
    lines = [x.strip() for x in data.split(b"\n")]
    full = [i for i, x in enumerate(lines) if x]
    return [lines[i] for i in full], full


def _ids(lines: list[bytes], seed: int, bits: int) -> list[bytes]:
    if bits == 8 * ID:
        return [xxhash.xxh3_128_digest(x, seed) for x in lines]
    return [(xxhash.xxh3_128_intdigest(x, seed) & ((1 << bits) - 1)).to_bytes(ID, "big") for x in lines]


def cuts(ids: list[bytes]) -> list[int]:
    """The lines before which a chunk begins: 0, and every line after a least rolling hash.

    The hash rolls over two neighbouring lines and ends a chunk where it is less than the one before and not greater
    than the one after, so that two cuts are two lines apart at least and each rests on four lines alone. Where three
    hashes in a row are equal (equal lines, over and over), every second line of the stretch ends one.
    """
    if not ids:
        return []
    h = np.frombuffer(b"".join(x[-8:] for x in ids), ">u8").astype(np.uint64)
    r = mixed(np.concatenate([h[:1], h[1:] + h[:-1] * _STEP])).tolist()
    out, flat = [0], 0
    for i in range(1, len(r) - 1):
        flat = flat + 1 if r[i] == r[i - 1] and r[i] == r[i + 1] else 0
        if (r[i] < r[i - 1] and r[i] <= r[i + 1]) or (flat and flat % 2 == 0):
            out.append(i + 1)
    return out


def runs_of(ids: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(first, after, low, high) of the runs of lines that are looked up: every chunk of several lines and every seam, the
    two lines around a cut. Around them, lines from ``low`` to ``high`` may belong to the same repeat: the neighbouring
    chunks and BEYOND lines more, in which a cut may rest on what stands outside of the repeat."""
    n = len(ids)
    at = [*cuts(ids), n]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        before, after = at[max(0, k - 1)], at[min(len(at) - 1, k + 2)]
        if b - a > 1:
            yield a, b, max(0, before - BEYOND), min(n, after + BEYOND)
        if a:
            yield a - 1, a + 1, max(0, before - BEYOND), min(n, b + BEYOND)


def own_repeats(ids: list[bytes]) -> list[tuple[int, int]]:
    """(first, after) of the lines that repeat earlier lines of the same text: runs seen before, extended as far as both
    places agree without meeting."""
    seen: dict[bytes, int] = {}
    out = []
    for a, b, _, _ in sorted(runs_of(ids)):
        first = seen.setdefault(b"".join(ids[a:b]), a)
        gap = a - first
        if gap < b - a:
            continue
        while a > gap and b - a < gap and ids[a - 1] == ids[a - 1 - gap]:
            a -= 1
        while b < len(ids) and b - a < gap and ids[b] == ids[b - gap]:
            b += 1
        out.append((a, b))
    return out


def line_contents(docs: DataFrame, seed: int = 0, bits: int = 8 * ID) -> DataFrame:
    """(key, line): the lines of texts with several, each once a batch, and their identifiers."""
    schema = pa.schema([("key", pa.binary()), ("line", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(lines: set[bytes]) -> pa.RecordBatch:
            found = list(lines)
            return pa.RecordBatch.from_arrays([pa.array(_ids(found, seed, bits), pa.binary()), pa.array(found, pa.binary())], schema=schema)

        for batch in batches:
            lines: set[bytes] = set()
            size = 0
            for raw in text_bytes(batch.column(0)):
                trimmed, _ = _lines(raw)
                if len(trimmed) > 1:
                    lines.update(trimmed)
                    size += len(raw)
                if size > BATCH_BYTES:
                    yield rows(lines)
                    lines, size = set(), 0
            yield rows(lines)

    return docs.select("text").mapInArrow(run, "key binary, line binary")


def line_runs(docs: DataFrame, seed: int = 0, bits: int = 8 * ID) -> DataFrame:
    """(doc_id, place, run, before, behind, lines) of the runs of every text, and (doc_id, place, lines) without a run for
    its own repeats. ``run``, ``before`` and ``behind`` are the identifiers of their lines in a row, ``lines`` the numbers of
    all of them among the text's lines; ``place`` hashes the text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("place", pa.int64()), ("run", pa.binary()), ("before", pa.binary()), ("behind", pa.binary()),
        ("lines", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            size = 0
            for doc_id, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                trimmed, full = _lines(raw)
                if len(trimmed) < 2:
                    continue
                ids = _ids(trimmed, seed, bits)
                found = [(b"".join(ids[a:b]), b"".join(ids[low:a]), b"".join(ids[b:high]), full[low:high]) for a, b, low, high in runs_of(ids)]
                found += [(None, None, None, full[a:b]) for a, b in own_repeats(ids)]
                for column, part in zip(rows, ([doc_id] * len(found), [place] * len(found), *zip(*found))):
                    column += part
                size += len(raw)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)
                    rows, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    types = "doc_id long, place long, run binary, before binary, behind binary, lines array<int>"
    return docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(run, types)


def _rank() -> Column:
    """The order of documents: null ids come before all others, and among them texts by their hash."""
    return F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.when(F.col("doc_id").isNull(), F.col("place")).otherwise(0).alias("text"))


def _settled(met: DataFrame) -> DataFrame:
    """(doc_id, place, first, after): runs extended, line by line, over what agrees around them with the first place."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("first", pa.int32()), ("after", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, after = [], []
            for mine, before, behind, there_before, there_behind, lines in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                a = len(before or b"") // ID
                b = a + len(mine) // ID if mine is not None else len(lines)
                k = 1
                while mine is not None and k * ID <= min(len(before), len(there_before)) and before[len(before) - k * ID :] == there_before[len(there_before) - k * ID :]:
                    a, k = a - 1, k + 1
                k = 0
                while mine is not None and (k + 1) * ID <= min(len(behind), len(there_behind)) and behind[k * ID : (k + 1) * ID] == there_behind[k * ID : (k + 1) * ID]:
                    b, k = b + 1, k + 1
                first.append(lines[a])
                after.append(lines[b - 1] + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int32()), pa.array(after, pa.int32())], schema=schema)

    columns = ("doc_id", "place", "run", "before", "behind", "there_before", "there_behind", "lines")
    return met.select(*columns).mapInArrow(run, "doc_id long, place long, first int, after int")


def repeats(docs: DataFrame, bits: int = 8 * ID) -> DataFrame:
    """(doc_id, place, first, after): the line ranges whose content another place has first.

    Identifiers are verified: lines are brought together by their bytes, each once, and should two have one identifier,
    all are named anew with another seed. So comparing identifiers compares the bytes. ``bits`` is lowered only in tests,
    to provoke that.
    """
    seed = 0
    while True:
        several = line_contents(docs, seed, bits).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_lines")).where("_lines > 1")
        if several.isEmpty():
            break
        seed += 1
    runs = materialise(line_runs(docs, seed, bits), "runs")
    cross = runs.where("run IS NOT NULL")
    first = cross.groupBy("run").agg(
        F.min(_rank()).alias("_least"), F.max(_rank()).alias("_most"), F.min_by(F.struct("before", "behind"), F.struct(_rank(), F.col("place"), F.col("lines"))).alias("_there")
    )
    first = first.where("_most > _least").select("run", "_least", "_there")
    later = cross.join(first, "run").where(_rank() > F.col("_least"))
    later = later.withColumns({"there_before": F.col("_there.before"), "there_behind": F.col("_there.behind")}).drop("_least", "_there")
    own = runs.where("run IS NULL").withColumns({c: F.lit(None).cast("binary") for c in ("there_before", "there_behind")})
    return _settled(later.unionByName(own))


def _merged(spans: DataFrame) -> DataFrame:
    """The ranges of each row's ``_spans`` in order, those that meet as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                done: list[dict] = []
                for s in sorted(ranges, key=lambda s: s["first"]):
                    if done and s["first"] <= done[-1]["after"]:
                        done[-1]["after"] = max(done[-1]["after"], s["after"])
                    else:
                        done.append(dict(s))
                out.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(2).type)], batch.schema.names)

    return spans.mapInArrow(run, "_doc long, _place long, _spans array<struct<first:int,after:int>>")


def deduplicate(docs: DataFrame, bits: int = 8 * ID) -> DataFrame:
    """All rows, ``text`` without its repeated chunks of lines, and ``removed_lines``.

    Lines that are not blank are compared without the white space around them. A rolling hash over their hashes cuts a
    text into chunks wherever it is least among its neighbours, so the same lines are cut alike wherever they stand.
    Every chunk of two or more lines, and the two lines around every cut, are looked up in all texts; where another
    place has them first, they go, with the lines around them that agree with that place. So a whole copy of several
    lines goes whole, and of a run of lines inside different texts all goes once it holds a cut: from nine lines on
    nearly always, of shorter ones as stated in the README. A line that is repeated alone stays.

    Of equal runs the first stays: that of the least ``doc_id`` (null before all, those by a hash of the text), and in
    it the first. Rows with equal ids count as one document, so neither removes from the other, and repeated rows stay
    alike; so do rows without id and with one text. Blank lines stay, but not those inside a removed run. Null and empty
    texts, and texts of one line, stay as they are; a text all of whose lines are repeats becomes empty. Very long texts
    are read line by line and only identifiers move. An empty table gives no rows. Other columns pass through, whatever
    they are called; ``removed_lines`` is replaced.
    """
    spans = repeats(docs.select("doc_id", "text"), bits).groupBy("doc_id", "place").agg(
        F.collect_set(F.struct("first", "after")).alias("_spans")
    )
    spans = _merged(spans.select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place"), "_spans"))
    placed, names = keep_columns(docs, "doc_id", "text")
    placed = placed.withColumn("_at", F.xxhash64("text"))
    out = placed.join(spans, placed["doc_id"].eqNullSafe(spans["_doc"]) & (placed["_at"] == spans["_place"]), "left")
    out = out.withColumn("_lines", F.when(F.col("_spans").isNotNull(), F.split("text", "\n")))
    start = F.concat(F.array(F.lit(0)), F.col("_spans.after"))
    end = F.concat(F.col("_spans.first"), F.array(F.size("_lines")))
    parts = F.zip_with(start, end, lambda a, b: F.slice("_lines", a + 1, b - a))
    out = out.withColumn("_left", F.flatten(parts))
    out = out.withColumn("text", F.coalesce(F.array_join("_left", "\n"), F.col("text")))
    out = out.withColumn("removed_lines", F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long"))
    return put_back(out, names, "removed_lines")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated chunks of lines."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
