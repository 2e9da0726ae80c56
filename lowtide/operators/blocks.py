"""Operators on stored blocks (keys..., block_no, start_i, samples, fs) that never take a block apart into rows.

What moves samples in time cuts each block into the slices that belong to other blocks; what adds channels together is
one small sparse product per block over the channels met there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowtide.operators.channels import MONO_LFE_DB, MONO_MAIN_DB, is_lfe
from lowtide.operators.ordering import running_sum
from lowtide.operators.samples import BLOCK, whole_samples

BATCH_SAMPLES = 1 << 19


def with_length(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``n``, the length of the series, where blocks do not carry it."""
    if "n" in blocks.columns:
        return blocks
    sizes = blocks.groupBy(*keys).agg(F.max(F.col("start_i") + F.size("samples")).alias("n"))
    return blocks.join(sizes, list(keys))


def recut(blocks: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Blocks of ``block`` samples from pieces (keys..., fs, n, start_i, samples) that lie anywhere in 0..n.

    A piece sends one slice to each block that it overlaps, two at most where pieces are no longer than a block. What is
    outside of the series is dropped, what no piece covers is silence; ``fills`` names a block that exists even so.
    """
    keys = list(keys)
    low, high = F.greatest(F.col("start_i"), F.lit(0)), F.least(F.col("start_i") + F.size("samples"), F.col("n"))
    lands = F.when(low < high, F.sequence(F.floor(low / block), F.floor((high - 1) / block)))
    own = F.col("fills") if "fills" in blocks.columns else F.lit(None).cast("long")
    targets = F.array_union(F.coalesce(lands, F.array().cast("array<bigint>")), F.array_compact(F.array(own)))
    to = F.col("block_no")
    a, b = F.greatest(low, to * block), F.least(high, (to + 1) * block)
    part = F.slice("samples", F.greatest(a - F.col("start_i") + 1, F.lit(1)).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    sent = blocks.select(*keys, "fs", "n", "start_i", "samples", F.explode(targets).alias("block_no"))
    part = F.when(a < b, part).otherwise(F.array().cast("array<double>"))
    sent = sent.select(*keys, "fs", "n", "block_no", F.struct(F.greatest(a - to * block, F.lit(0)).cast("int").alias("at"), part.alias("s")).alias("piece"))
    met = sent.groupBy(*keys, "block_no").agg(F.first("fs").alias("fs"), F.first("n").alias("n"), F.array_sort(F.collect_list("piece")).alias("_p"))
    silence = lambda k: F.array_repeat(F.lit(0.0), F.greatest(k, F.lit(0)).cast("int"))
    laid = F.aggregate("_p", F.array().cast("array<double>"), lambda acc, p: F.when(F.size(p["s"]) == 0, acc).otherwise(F.concat(acc, silence(p["at"] - F.size(acc)), p["s"])))
    met = met.withColumn("_laid", laid)
    size = F.least(F.lit(block).cast("long"), F.col("n") - F.col("block_no") * block)
    return met.select(*keys, "block_no", (F.col("block_no") * block).alias("start_i"), "fs", "n", F.concat("_laid", silence(size - F.size("_laid"))).alias("samples"))


def shift(blocks: DataFrame, keys: Sequence[str], ms: float | Column, block: int = BLOCK) -> DataFrame:
    """Delay (positive) or advance (negative) by whole samples, length kept; the vacated end is silence. ``block`` is the
    length of the stored blocks. One exchange, of slices."""
    moved = with_length(blocks, keys).withColumn("samples", F.col("samples").cast("array<double>"))
    return recut(moved.withColumns({"fills": F.floor(F.col("start_i") / block), "start_i": F.col("start_i") + whole_samples(ms)}), keys, block)


def cut(blocks: DataFrame, keys: Sequence[str], start_s: float, end_s: float) -> DataFrame:
    """Samples from start to end seconds, end sample included, in the blocks they are in; positions are kept. A range
    outside of a series leaves it as it is. Other blocks are left out by ``start_i`` before their samples are looked at."""
    sized = with_length(blocks, keys)
    seconds = F.col("n") / F.col("fs")
    outside = (F.lit(float(start_s)) >= seconds) | (F.lit(float(end_s)) > seconds)
    first, last = F.floor(F.lit(float(start_s)) * F.col("fs")), F.floor(F.lit(float(end_s)) * F.col("fs"))
    size = F.size("samples")
    met = sized.where(outside | ((F.col("start_i") <= last) & (F.col("start_i") + size > first)))
    low = F.when(outside, F.col("start_i")).otherwise(F.greatest("start_i", first))
    high = F.when(outside, F.col("start_i") + size).otherwise(F.least(F.col("start_i") + size, last + 1))
    # Never negative, as Spark may look at the slice before it has tested the block.
    part = F.slice("samples", F.greatest(low - F.col("start_i") + 1, F.lit(1)).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return met.withColumns({"samples": part, "start_i": low}).select(*[c for c in blocks.columns if c != "n"])


def concatenate(blocks: DataFrame, key: str, plan: DataFrame, group: str = "merged_id", ordinal: str = "ord", block: int = BLOCK) -> DataFrame:
    """Lay series end to end as ``plan`` (key, group, ordinal) says; the first input gives the rate. Starts are running sums
    of lengths, one row a series; blocks are sent on in slices."""
    sized = with_length(blocks, [key])
    heads = sized.where("start_i = 0").select(key, "n", "fs").join(plan, key)
    starts = running_sum(heads, [group], ordinal, F.col("n"), "_start", inclusive=False)
    whole = heads.groupBy(group).agg(F.sum("n").alias("_n"), F.min_by("fs", ordinal).alias("_fs"))
    placed = starts.select(key, group, "_start").join(whole, group)
    moved = sized.select(key, "start_i", F.col("samples").cast("array<double>").alias("samples")).join(placed, key)
    return recut(moved.select(group, F.col("_fs").alias("fs"), F.col("_n").alias("n"), (F.col("start_i") + F.col("_start")).alias("start_i"), "samples"), [group], block)


def channel_matrix(blocks: DataFrame, to: Column, keys: Sequence[str] = ("title",), name: str = "channel", kind: str = "string") -> DataFrame:
    """Sums of channels: each block goes, times a gain, to the ``target``s of ``to`` (array<struct<target, gain>>).

    All channels of one stretch of one title meet once; there the sparse matrix of gains is multiplied with them. Channels
    may end early and are silent then. The result is (keys..., name, block_no, start_i, fs, samples).
    """
    keys = list(keys)
    by = [*keys, "block_no", "start_i"]
    sent = blocks.select(*by, "fs", F.col("samples").cast("array<double>").alias("samples"), to.alias("to")).where(F.size("to") > 0)
    ordered = sent.repartition(*by).sortWithinPartitions(*by)
    fields = [sent.schema[k] for k in keys] + [T.StructField(name, T._parse_datatype_string(kind))]
    schema = T.StructType([*fields, T.StructField("block_no", T.LongType()), T.StructField("start_i", T.LongType()), sent.schema["fs"], T.StructField("samples", T.ArrayType(T.DoubleType()))])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rate, sums, done, size = None, None, {}, [], 0

        def told() -> list[tuple]:
            return [(*here[:width], target, *here[width:], rate, x) for target, x in sums.items()]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(schema)
            arrays = [pa.array(list(c), from_spark) for c, from_spark in zip(columns[:-1], kinds)]
            flat = np.concatenate(columns[-1]) if done else np.zeros(0)
            ends = np.cumsum([0, *[len(x) for x in columns[-1]]])
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float64())))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for part in batches:
            places = list(zip(*[part.column(k).to_pylist() for k in range(len(by) + 1)]))
            lists = part.column(len(by) + 1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, (place, targets) in enumerate(zip(places, part.column(len(by) + 2).to_pylist())):
                if place[:-1] != here:
                    if here is not None:
                        done += told()
                        size += sum(map(len, sums.values()))
                    if size > BATCH_SAMPLES:
                        yield batch()
                        done, size = [], 0
                    here, sums = place[:-1], {}
                rate = place[-1]
                x = values[offsets[k] : offsets[k + 1]]
                for t in targets:
                    mine = sums.get(t["target"])
                    if mine is None:
                        sums[t["target"]] = x * t["gain"]
                        continue
                    if len(mine) < len(x):
                        mine = sums[t["target"]] = np.concatenate([mine, np.zeros(len(x) - len(mine))])
                    mine[: len(x)] += x * t["gain"]
        if here is not None:
            done += told()
        yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields[:-1]]
    return ordered.mapInArrow(run, schema)


def _to(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(t.alias("target"), g.cast("double").alias("gain")) for t, g in pairs])


def _nowhere() -> Column:
    return F.array().cast("array<struct<target:string,gain:double>>")


def mono_mix(blocks: DataFrame) -> DataFrame:
    """One channel ``mono`` a title: fixed gains if the title has an LFE, else equal parts. Channels are counted from first
    blocks alone."""
    known = blocks.where("start_i = 0").groupBy("title").agg(F.count_distinct("channel").alias("_n"), F.bool_or(is_lfe(F.col("channel"))).alias("_lfe"))
    gain = F.when(~F.col("_lfe"), 1.0 / F.col("_n")).when(is_lfe(F.col("channel")), 10.0 ** (MONO_LFE_DB / 20.0)).otherwise(10.0 ** (MONO_MAIN_DB / 20.0))
    return channel_matrix(blocks.join(known, "title"), _to((F.lit("mono"), gain)))


def mix(blocks: DataFrame, mode: str, source: str, target: str, gain_db: float = 0.0) -> DataFrame:
    """Mix one channel into another, as ``channels.mix`` does with rows: add, subtract, copy, move or swap."""
    g = F.lit(10.0 ** (gain_db / 20.0))
    name, one = F.col("channel"), F.lit(1.0)
    is_source, is_target = name == source, name == target
    own, there = (name, one), (F.lit(target), g)
    if mode == "add":
        to = F.when(is_source, _to(own, there)).otherwise(_to(own))
    elif mode == "subtract":
        to = F.when(is_source, _to(own, (F.lit(target), -g))).otherwise(_to(own))
    elif mode == "copy":
        to = F.when(is_source, _to(own, there)).when(is_target, _nowhere()).otherwise(_to(own))
    elif mode == "move":
        to = F.when(is_source, _to((name, F.lit(0.0)), there)).when(is_target, _nowhere()).otherwise(_to(own))
    elif mode == "swap":
        to = F.when(is_source, _to(there)).when(is_target, _to((F.lit(source), g))).otherwise(_to(own))
    else:
        raise ValueError(f"unknown mix mode {mode}")
    return channel_matrix(blocks, to)


def route(blocks: DataFrame, routes: DataFrame, on: Sequence[str] = ("title",)) -> DataFrame:
    """Outputs ``o`` of a routing table (title, i, w, o): the sums of the inputs ``ch`` routed to them, once per input."""
    pairs = routes.groupBy(*on, F.col("i").alias("ch")).agg(F.collect_set("o").alias("_o"))
    to = F.transform("_o", lambda o: F.struct(o.alias("target"), F.lit(1.0).alias("gain")))
    return channel_matrix(blocks.join(pairs, [*on, "ch"]), to, on, "o", routes.schema["o"].dataType.simpleString())
