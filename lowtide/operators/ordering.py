"""Positions, running sums, group extremes and exact quantiles that never put
one whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide.session import materialise

DEFAULT_BLOCK = 1 << 16


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "i") -> DataFrame:
    """0-based position of every row inside its key, for keys of any size.

    One range shuffle on (keys, order) splits a hot key over many partitions.
    The sorted rows are stored once with their running id, so partition and
    offset are stable; only one row per (key, partition) is then prefix-summed.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = materialise(ranged.withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    stored = stored.withColumn("_pid", F.shiftright("_mid", 33))
    runs = stored.groupBy(*keys, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *keys, "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    out = stored.join(runs, [*keys, "_pid"])
    return out.withColumn(name, F.col("_mid") - F.col("_first") + F.col("_base")).drop(
        "_mid", "_pid", "_first", "_base"
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    name: str,
    block: int = DEFAULT_BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` in order of the integer column ``pos``.

    Rows are windowed inside blocks of ``block`` positions; block totals, which
    are ``block`` times fewer, carry the sum from one block to the next.
    """
    keys = list(keys)
    cut = df.withColumn("_blk", F.floor(F.col(pos) / block)).withColumn("_val", value)
    totals = cut.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_tot"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_carry")
    )
    last = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, last)
    )
    out = cut.withColumn("_in", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    out = out.join(carry, [*keys, "_blk"])
    return out.withColumn(name, F.col("_in") + F.col("_carry")).drop("_blk", "_val", "_in", "_carry")


def with_group_agg(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-key aggregates to every row: partial aggregation, then an equi
    join, which adaptive execution broadcasts or splits when a key is hot."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[expr.alias(n) for n, expr in aggs.items()])
    return df.join(stats, keys)


#: Equal parts that a bin with a wanted rank is cut in.
QUANTILE_PARTS = 4096


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, per_octave: int = 32
) -> DataFrame:
    """Exact, linearly interpolated quantile per key, for keys of any size.

    Equal values are counted first (so a repeated value is one row), distinct
    values are binned on a logarithmic scale, and bin counts locate the one or two
    bins that hold the wanted ranks. Those are cut into equal parts between their
    least and greatest value, part counts locate the ranks again, and only the
    parts that hold them are ranked: no bin, however full, is one group.
    """
    keys = list(keys)
    v = F.col(value)
    counted = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    scaled = F.log2(1.0 + F.abs("_v") * 1e12) * per_octave
    counted = counted.withColumn("_slot", F.floor(F.signum("_v") * scaled))
    for key in (*keys, "_slot"):  # said for both uses below, so one shuffle serves them
        counted = counted.where(F.col(key).isNotNull())
    holds = lambda r: (F.col(r) >= F.col("_base")) & (F.col(r) < F.col("_base") + F.col("_n"))
    ends = (Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys)
    bins = counted.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    bins = bins.withColumns({
        "_base": F.coalesce(F.sum("_n").over(total.orderBy("_slot").rowsBetween(*ends)), F.lit(0)),
        "_all": F.sum("_n").over(total),
    })
    rank = (F.col("_all") - 1) * F.lit(float(q))
    bins = bins.withColumn("_lo", F.floor(rank)).withColumn("_hi", F.ceil(rank)).withColumn("_frac", rank - F.floor(rank))
    wanted = bins.where(holds("_lo") | holds("_hi")).drop("_n")

    width = F.col("_most") - F.col("_least")
    part = F.when(width > 0, F.floor((F.col("_v") - F.col("_least")) / width * QUANTILE_PARTS)).otherwise(0)
    inside = counted.join(wanted, [*keys, "_slot"]).withColumn("_part", part.cast("int"))
    by = [*keys, "_slot", "_part"]
    about = ["_base", "_all", "_lo", "_hi", "_frac"]
    parts = inside.groupBy(*by, *about).agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys, "_slot").orderBy("_part").rowsBetween(*ends)
    parts = parts.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.where(holds("_lo") | holds("_hi")).drop("_n")

    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(*ends)
    ranked = inside.select(*by, "_v", "_c").join(parts, by).withColumn(
        "_start", F.col("_base") + F.coalesce(F.sum("_c").over(order), F.lit(0))
    )
    at = lambda r: F.max(
        F.when((F.col(r) >= F.col("_start")) & (F.col(r) < F.col("_start") + F.col("_c")), F.col("_v"))
    )
    picked = ranked.groupBy(*keys).agg(
        at("_lo").alias("_a"), at("_hi").alias("_b"), F.first("_frac").alias("_f"), F.first("_all").alias("n")
    )
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name), "n")
