"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, text_bytes
from lowtide.session import materialise

#: Bytes that the rolling hash sees: each doubling step widens its window.
WINDOW = 32
BUFFER = 1 << 20
#: A random value per byte, derived from its number.
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: bytes, mean: int, most: int) -> list[int]:
    """Ends of the chunks of ``data``: where a rolling hash of the last 32 bytes has zero low bits, or ``most`` bytes
    after the last end. They depend on the bytes alone, so equal texts are cut alike and an edit moves few cuts."""
    mask = np.uint32((1 << (mean.bit_length() - 1)) - 1)
    found = []
    for lo in range(0, len(data), BUFFER):
        start = max(0, lo - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), lo + BUFFER) - start, start)]
        step = 1
        while step < WINDOW:
            wider = h.copy()
            wider[step:] += h[:-step] << np.uint32(step)
            h, step = wider, step * 2
        at = np.flatnonzero(((h ^ (h >> np.uint32(15))) & mask) == 0) + start
        found.append(at[at >= max(lo, WINDOW - 1)] + 1)
    ends, last = [], 0
    for end in np.concatenate(found).tolist() if found else []:
        ends.extend(range(last + most, end, most))
        ends.append(end)
        last = end
    ends.extend(range(last + most, len(data), most))
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    return ends


def _chunks(data: bytes, mean: int, most: int) -> list[bytes]:
    cuts = cut_points(data, mean, most)
    return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


def _key(chunk: bytes, bits: int) -> int:
    """A signed chunk hash; ``bits`` is lowered only in tests, to provoke collisions."""
    h = xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)
    return h - (1 << 64) if h >= 1 << 63 else h


def recipes(docs: DataFrame, mean: int = 1024, most: int = 8192, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe) per row: the digest of the normalised text and its chunk hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, recipe = [], []
            for raw in text_bytes(batch.column(1)):
                data = raw.lower()  # of bytes: A-Z only
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append([_key(c, bits) for c in _chunks(data, mean, most)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.list_(pa.int64()))],
                ["doc_id", "text_sha256", "recipe"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_sha256 string, recipe array<long>")


def chunk_rows(docs: DataFrame, mean: int = 1024, most: int = 8192, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, ord, key, chunk): the chunks with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("ord", pa.int32()), ("key", pa.int64()), ("chunk", pa.binary())])
        for batch in batches:
            rows, size = [[], [], [], [], []], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                data = raw.lower()
                sha = hashlib.sha256(data).hexdigest()
                for i, chunk in enumerate(_chunks(data, mean, most)):
                    for column, value in zip(rows, (doc_id, sha, i, _key(chunk, bits), chunk)):
                        column.append(value)
                    size += len(chunk)
                    if size > 4 * BUFFER:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)
                        rows, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_sha256 string, ord int, key long, chunk binary")


def deduplicate(docs: DataFrame, mean: int = 1024, most: int = 8192, bits: int = 64) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z. Every distinct chunk is moved once and compared by its
    bytes; a hash that stands for several contents gets one identifier per content, and documents are equal when their
    ordered identifiers are. Only narrow rows (identifier lists) move after that.

    The row with the largest ``doc_id`` of a group stays. A null text counts as empty, so null and empty texts form one
    group; a null ``doc_id`` never wins over another; rows that repeat the staying ``doc_id`` stay with it; a group of
    null ids keeps all of them. Very long texts are cut in pieces of at most ``most`` bytes. An empty table gives none.
    """
    cut = dict(mean=mean, most=most, bits=bits)
    contents = chunk_rows(docs, **cut).groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("_uses"))
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("_contents")).where("_contents > 1").select("key")
    clashes = materialise(
        several.join(contents, "key").select("key", "chunk", F.sha2("chunk", 256).alias("content")), "clashes"
    )
    exact = (
        chunk_rows(docs, **cut)
        .join(clashes, ["key", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("ord", "content"))).alias("_exact"))
    )
    rows = recipes(docs, **cut)
    sides = rows.alias("a").join(
        exact.alias("b"),
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256")),
        "left",
    )
    rows = sides.select("a.doc_id", "a.text_sha256", "recipe", F.coalesce("_exact", F.array().cast("array<struct<ord:int,content:string>>")).alias("_exact"))
    groups = rows.groupBy("recipe", "_exact").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["recipe", "_exact"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""


@query("op6_exact_dedup", SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return deduplicate(table(spark, sf_dir, "documents"))
