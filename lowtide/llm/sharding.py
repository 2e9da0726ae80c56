"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.operators.ordering import with_position

#: 52 bits of the digest: exact as a double.
HEX_DIGITS = 13


def shard_costs(key: str, weights: Sequence[float]) -> Column:
    """One cost per shard: an exponential variate of the hashed (key, shard), over the shard's weight."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def cost(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(text, F.lit(f":{shard}")))
        draw = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 1.0) / float(16**HEX_DIGITS + 1)
        return -F.log(draw) / F.lit(float(weight))

    return F.array(*[cost(i, w) for i, w in enumerate(weights)])


def assign(
    df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 24, added: float | None = None
) -> DataFrame:
    """Adds ``shard``, the shard of least cost, and ``grown_shard``, the shard once one of weight ``added`` joins.

    Each shard wins a share of keys in proportion to its weight. The cost of a (key, shard) pair depends on nothing
    else, so a new shard takes rows only into itself. A null key counts as the empty key; rows with equal keys share a
    shard; ties go to the lower number; texts, lengths and repeated rows play no part. Without ``added``,
    ``grown_shard`` is null. Columns of these names in ``df`` are replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    n = len(weights)
    every = list(weights) + ([added] if added is not None else [])
    costs = df.withColumn("_cost", shard_costs(key, every))
    now = F.array_min(F.slice("_cost", 1, n))
    out = costs.withColumn("shard", (F.array_position("_cost", now) - 1).cast("int"))
    grown = F.array_position("_cost", F.array_min("_cost")) - 1 if added is not None else F.lit(None)
    return out.withColumn("grown_shard", grown.cast("int")).drop("_cost")


def with_slots(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``slot``, the gapless position from 0 inside each shard; a shard is never gathered in one task."""
    return with_position(df, ["shard"], order, "slot")


def _sql(shards: int = 24) -> str:
    """The same draws; the checksum byte by byte, over a table that follows from its polynomial (a fixed value)."""
    draw = f"(('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || ':' || s), 1, {HEX_DIGITS}))::BIGINT::DOUBLE + 1) / {float(16**HEX_DIGITS + 1)!r}"
    first = lambda n: f"list_position(cost[1:{n}], list_min(cost[1:{n}])) - 1"
    return f"""
WITH RECURSIVE bit(i, k, v) AS (SELECT i, 0, i FROM range(256) AS x(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
e AS (SELECT doc_id, octet_length(bytes) + 8 AS size, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d),
f AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM e, tab),
g AS (SELECT *, [-ln({draw}) FOR s IN range({shards + 1})] AS cost FROM f),
h AS (SELECT doc_id, size, text_crc32, {first(shards)} AS shard, {first(shards + 1)} AS grown_shard FROM g)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM h"""


@query("op5_sharding", _sql())
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 23 by ``doc_id``, and where they go with one shard more.

    A null text has no bytes: size 8 and the checksum of nothing.
    """
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_slots(assign(docs, "doc_id", (1.0,) * 24, added=1.0), ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
