"""Energies and peaks kept beside stored blocks, so that windows of any length are answered without their samples.

A block carries running sums of its squares and a tree of its greatest magnitudes. The energy of any stretch is then a
difference of two numbers in the blocks at its ends and whole blocks in between; its peak is a few entries of trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lowtide.functions.levels import SILENCE_DB
from lowtide.operators.stats import INTEGRATION


def prefix_energy(x: np.ndarray) -> np.ndarray:
    """Sums of the squares before each place, and of all."""
    return np.concatenate([[0.0], np.cumsum(x * x)])


def peak_tree(x: np.ndarray) -> np.ndarray:
    """Greatest magnitudes of pairs, of fours and so on to the whole, level after level; the magnitudes are level 0 and
    not kept. A level of odd length ends in its last entry alone."""
    levels, here = [], np.abs(x)
    while len(here) > 1:
        if len(here) % 2:
            here = np.append(here, here[-1])
        here = here.reshape(-1, 2).max(axis=1)
        levels.append(here)
    return np.concatenate(levels) if levels else here


def tree_peak(tree: np.ndarray, size: int, low: int, high: int, at) -> float:
    """Greatest magnitude of places low to high of a block of ``size`` samples; ``at(i)`` gives the magnitude of a place,
    asked for at most two of them."""
    top, begin, n = 0.0, -1, size
    while low < high:
        if low % 2:
            top = max(top, at(low) if begin < 0 else tree[begin + low])
            low += 1
        if high % 2 and low < high:
            top = max(top, at(high - 1) if begin < 0 else tree[begin + high - 1])
            high -= 1
        if low >= high:
            break
        low, high = low // 2, high // 2
        begin, n = (0 if begin < 0 else begin + n), -(-n // 2)
    return float(top)


def with_pyramid(blocks: DataFrame) -> DataFrame:
    """Adds ``energy`` and ``peaks`` to blocks; to be stored with them."""
    names = [c for c in blocks.columns if c not in ("energy", "peaks")]
    kept = blocks.select(*names)
    at = names.index("samples")
    schema = T.StructType([*kept.schema.fields, T.StructField("energy", T.ArrayType(T.DoubleType())), T.StructField("peaks", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
            parts = [values[a:b] for a, b in zip(ends, ends[1:])]
            made = [_lists([f(x) for x in parts]) for f in (prefix_energy, peak_tree)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return kept.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.float64()))


def levels(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rms, peak, crest factor and headroom in dB from the last running sum and the top of the tree of each block."""
    power = F.sum(F.element_at("energy", -1)) / F.sum(F.size("energy") - 1)
    top = F.max(F.element_at("peaks", -1))
    db = lambda x: 10.0 * F.log10(x)
    return blocks.where(F.size("energy") > 1).groupBy(*keys).agg(
        db(power).alias("rms_db"), (2 * db(top)).alias("peak_db"), (2 * db(top) - db(power)).alias("crest_db"), (-2 * db(top)).alias("headroom_db")
    )


def windowed_peaks(blocks: DataFrame, keys: Sequence[str], times: dict[str, float] | None = None) -> DataFrame:
    """Loudest non-overlapping window per integration time (keys..., kind, db), as ``stats.windowed_peaks`` has it.

    A block tells its loudest whole window and the parts that it has of the windows over its ends: three rows per time,
    whatever its length; samples are not read and not made into rows.
    """
    keys = list(keys)
    times = dict(times or INTEGRATION)
    told = blocks.select(*keys, "start_i", "fs", "energy")
    schema = T.StructType([*[told.schema[k] for k in keys], T.StructField("kind", T.StringType()), T.StructField("win", T.LongType()), T.StructField("w", T.LongType()), T.StructField("e", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = list(zip(*[batch.column(k).to_pylist() for k in range(width)]))
            starts, rates = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            lists = batch.column(width + 2)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = []
            for k, (key, start, fs) in enumerate(zip(who, starts, rates)):
                sums = values[ends[k] : ends[k + 1]]
                n = len(sums) - 1
                if n < 1:
                    continue
                for kind, seconds in times.items():
                    win = int(fs * seconds)
                    first, last = start // win, (start + n - 1) // win
                    edges = np.clip(np.arange(first, last + 2) * win - start, 0, n)
                    each = sums[edges[1:]] - sums[edges[:-1]]
                    inner = each[1:-1]
                    if len(inner):  # no other block has a part of these
                        best = int(inner.argmax())
                        rows.append((*key, kind, win, first + 1 + best, float(inner[best])))
                    rows += [(*key, kind, win, w, float(each[w - first])) for w in {first, last}]
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], schema.names)

    each = told.mapInArrow(run, schema).groupBy(*keys, "kind", "win", "w").agg(F.sum("e").alias("e"))
    db = F.when(F.col("e") > 0, 10.0 * F.log10(F.col("e") / F.col("win"))).otherwise(SILENCE_DB)
    return each.groupBy(*keys, "kind").agg(F.max(db).alias("db"))


def range_levels(blocks: DataFrame, ranges: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """(keys..., low, high, rms_db, peak_db) of stretches ``low`` to ``high`` (its sample not included) of series.

    A stretch is sent to the stored blocks of ``block`` samples that it touches; a block wholly inside gives its totals,
    one at an end two running sums and some entries of its tree. Stretches are cut at the ends of their series and those
    outside have no row.
    """
    keys = list(keys)
    touched = ranges.where("low < high AND low >= 0").select(*keys, "low", "high", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("block_no"))
    met = touched.join(blocks.select(*keys, "block_no", "start_i", "samples", "energy", "peaks"), [*keys, "block_no"])
    a = F.greatest(F.col("low") - F.col("start_i"), F.lit(0)).cast("int")
    b = F.least(F.col("high") - F.col("start_i"), F.size("samples")).cast("int")
    met = met.select(*keys, "low", "high", a.alias("a"), b.alias("b"), "samples", "energy", "peaks").where("a < b")

    def parts(samples, energy, peaks, a, b):
        import pandas as pd

        rows = []
        for x, e, p, lo, hi in zip(samples, energy, peaks, a, b):
            rows.append((hi - lo, e[hi] - e[lo], tree_peak(p, len(x), lo, hi, lambda i: abs(x[i]))))
        return pd.DataFrame(rows, columns=["n", "e", "top"])

    told = F.pandas_udf(parts, "n long, e double, top double")
    each = met.select(*keys, "low", "high", told("samples", "energy", "peaks", "a", "b").alias("p"))
    whole = each.groupBy(*keys, "low", "high").agg(F.sum("p.n").alias("n"), F.sum("p.e").alias("e"), F.max("p.top").alias("top"))
    silent = lambda x, scale: F.when(x > 0, scale * F.log10(x)).otherwise(SILENCE_DB)
    return whole.select(*keys, "low", "high", silent(F.col("e") / F.col("n"), 10.0).alias("rms_db"), silent(F.col("top"), 20.0).alias("peak_db"))
