"""Biquad cascades over blocked signals.

A cascade is linear, so the state after a block is A * (state before) + e, where
e is the end state from silence and A depends on the cascade and the block
length alone. Three passes follow: end states of all blocks (parallel), a scan
of those small states in tiers (so a long track is no single group), and
the filter pass with each block's true starting state (parallel).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowtide.operators.samples import from_blocks, to_blocks
from lowtide.session import materialise

FANOUT = 1024
_CHUNK = 1024

SOS_TYPE = "array<struct<b0:double,b1:double,b2:double,a1:double,a2:double>>"


def flat_sos(sos: Column) -> Column:
    """array<struct> of sections to a flat array of doubles, five per section."""
    return F.flatten(F.transform(sos, lambda s: F.array(s["b0"], s["b1"], s["b2"], s["a1"], s["a2"])))


def _run(x: np.ndarray, coef: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter many rows at once, one time step after the other.

    x: (time, rows); coef: (sections, 5, rows); state: (sections, 2, rows).
    """
    y, ends = x, []
    for (b0, b1, b2, a1, a2), (z1, z2) in zip(coef, state):
        out = np.empty_like(y)
        for t, now in enumerate(y):
            res = b0 * now + z1
            z1, z2 = b1 * now - a1 * res + z2, b2 * now - a2 * res
            out[t] = res
        y = out
        ends.append((z1, z2))
    return y, np.array(ends).reshape(state.shape)


def _batches(frame: pd.DataFrame):
    """Rows of equal block and cascade length, as (row positions, x, coef)."""
    sizes = [(len(x), len(s)) for x, s in zip(frame["samples"], frame["sos"])]
    shape = pd.DataFrame(sizes, columns=["n", "k"])
    for _, part in shape.groupby(["n", "k"], sort=False):
        for at in range(0, len(part), _CHUNK):
            rows = part.index[at:at + _CHUNK].to_numpy()
            x = np.stack([np.asarray(frame["samples"].iat[r], dtype=float) for r in rows]).T
            sos = np.stack([np.asarray(frame["sos"].iat[r], dtype=float) for r in rows])
            yield rows, np.ascontiguousarray(x), np.ascontiguousarray(sos.reshape(len(rows), -1, 5).transpose(1, 2, 0))


def _end_states(frames):
    for frame in frames:
        ends: list = [None] * len(frame)
        for rows, x, coef in _batches(frame):
            _, state = _run(x, coef, np.zeros((coef.shape[0], 2, len(rows))))
            for r, e in zip(rows, state.reshape(-1, len(rows)).T):
                ends[r] = e
        out = frame.drop(columns=["samples"])
        out["n"] = [len(x) for x in frame["samples"]]
        out["state"] = ends
        yield out


def _filter_from(frames):
    for frame in frames:
        done: list = [None] * len(frame)
        for rows, x, coef in _batches(frame):
            start = np.stack([np.asarray(frame["state"].iat[r], dtype=float) for r in rows]).T
            y, _ = _run(x, coef, np.ascontiguousarray(start.reshape(coef.shape[0], 2, len(rows))))
            for r, col in zip(rows, y.T):
                done[r] = col
        out = frame.drop(columns=["state", "sos"])
        out["samples"] = done
        yield out


def _step_matrix(sos: Sequence[float]) -> np.ndarray:
    """State after one silent sample, for every unit starting state."""
    coef = np.asarray(sos, dtype=float).reshape(-1, 5)
    size = 2 * len(coef)
    wide = np.repeat(coef[:, :, None], size, axis=2)
    _, state = _run(np.zeros((1, size)), wide, np.eye(size).reshape(len(coef), 2, size))
    return state.reshape(size, size)


class _Powers:
    """Powers of the step matrix of a cascade, each computed once per batch."""

    def __init__(self):
        self.steps: dict[bytes, np.ndarray] = {}
        self.known: dict[tuple[bytes, int], np.ndarray] = {}

    def __call__(self, sos: np.ndarray, n: int) -> np.ndarray:
        name = sos.tobytes()
        if (name, n) not in self.known:
            if name not in self.steps:
                self.steps[name] = _step_matrix(sos)
            self.known[name, n] = np.linalg.matrix_power(self.steps[name], n)
        return self.known[name, n]


_STATE = T.ArrayType(T.DoubleType())
_PIECE = T.StructType([T.StructField("n", T.LongType()), T.StructField("state", _STATE)])


def _walk(powers: _Powers, sos, pieces, start) -> Iterator[np.ndarray]:
    """The state before each piece, then the state after the last one."""
    sos, state = np.asarray(sos, dtype=float), np.asarray(start, dtype=float)
    yield state
    for piece in pieces:
        state = powers(sos, int(piece["n"])) @ state + np.asarray(piece["state"], dtype=float)
        yield state


def _compose(sos: pd.Series, pieces: pd.Series) -> pd.DataFrame:
    """Length and end state, from silence, of consecutive pieces taken as one."""
    powers, sizes, ends = _Powers(), [], []
    for coef, run in zip(sos, pieces):
        *_, last = _walk(powers, coef, run, np.zeros(2 * len(coef) // 5))
        sizes.append(sum(int(p["n"]) for p in run))
        ends.append(last)
    return pd.DataFrame({"n": sizes, "state": ends})


def _starts(sos: pd.Series, pieces: pd.Series, start: pd.Series) -> pd.Series:
    """The true state at the start of every piece."""
    powers = _Powers()
    return pd.Series([list(_walk(powers, c, run, z))[:-1] for c, run, z in zip(sos, pieces, start)])


_compose_udf = F.pandas_udf(_compose, _PIECE)
_starts_udf = F.pandas_udf(_starts, T.ArrayType(_STATE)).asNondeterministic()  # evaluated once, below a generator


def _carry(pieces: DataFrame, keys: list[str], first: DataFrame | None, fanout: int, tiers: int) -> DataFrame:
    """(keys..., at, start) for pieces (keys..., at, sos, n, state). Each tier folds
    ``fanout`` neighbours into one piece; only the last tier spans a whole series,
    ``fanout ** (tiers - 1)`` times shorter than it."""
    by = [*keys, "_run"] if tiers > 1 else keys
    folded = pieces.withColumn("_run", F.floor(F.col("at") / fanout)) if tiers > 1 else pieces
    for key in by:  # said for both uses of the fold, so its shuffle is shared
        folded = folded.where(F.col(key).isNotNull())
    folded = folded.groupBy(*by).agg(
        F.first("sos").alias("sos"), F.array_sort(F.collect_list(F.struct("at", "n", "state"))).alias("_p")
    )
    if tiers > 1:
        one = folded.select(*keys, F.col("_run").alias("at"), "sos", _compose_udf("sos", "_p").alias("_c"))
        above = _carry(one.select(*keys, "at", "sos", "_c.n", "_c.state"), keys, first, fanout, tiers - 1)
        folded = folded.join(above.withColumnRenamed("at", "_run"), by)
    elif first is None:
        folded = folded.withColumn("start", F.transform(F.col("_p")[0]["state"], lambda _: F.lit(0.0)))
    else:
        folded = folded.join(first, keys)
    zipped = F.arrays_zip(F.col("_p")["at"].alias("at"), _starts_udf("sos", "_p", "start").alias("start"))
    return folded.select(*keys, F.explode(zipped).alias("_z")).select(*keys, "_z.at", "_z.start")


def _block_starts(blocks: DataFrame, keys: list[str], fanout: int, tiers: int, initial: str | None) -> DataFrame:
    """(keys..., at, start): the state before every block."""
    ids = [blocks.schema[k] for k in keys]
    slim = blocks.select(*keys, F.col("block_no").cast("long").alias("at"), "sos", F.col("samples").cast(_STATE).alias("samples"))
    shape = T.StructType([
        *ids, T.StructField("at", T.LongType()), T.StructField("sos", _STATE),
        T.StructField("n", T.LongType()), T.StructField("state", _STATE),
    ])
    first = None
    if initial is not None:
        first = blocks.where(F.col("block_no") == 0).select(*keys, F.col(initial).alias("start"))
    return _carry(slim.mapInPandas(_end_states, shape), keys, first, fanout, tiers)


def cascade(
    blocks: DataFrame, keys: Sequence[str], fanout: int = FANOUT, tiers: int = 2, initial: str | None = None
) -> DataFrame:
    """Run each row's cascade ``sos`` (flat, five doubles per section) causally over
    its series. ``blocks`` has (keys..., block_no, samples, sos, ...) and the cascade
    is one per key. The state before the first block is silence, or the array column
    named by ``initial``. Add a tier for every factor ``fanout`` in series length; with no tier, every series is one block
    and nothing is carried.
    """
    keys = list(keys)
    passed = [c for c in blocks.columns if c not in (*keys, "block_no", "sos", "samples", initial)]
    full = blocks.withColumn("samples", F.col("samples").cast(_STATE))
    if tiers:
        starts = _block_starts(blocks, keys, fanout, tiers, initial)
        full = full.join(starts.select(*keys, F.col("at").alias("block_no"), F.col("start").alias("state")), [*keys, "block_no"])
    else:
        silence = F.array_repeat(F.lit(0.0), (F.size("sos") / 5 * 2).cast("int"))
        full = full.withColumn("state", silence if initial is None else F.col(initial))
    fields = [*keys, "block_no", *passed, "samples"]
    out_schema = T.StructType([full.schema[name] for name in fields])
    return full.select(*fields, "sos", "state").mapInPandas(_filter_from, out_schema)


def _settled(sos: pd.Series) -> pd.Series:
    """Per unit of constant input, the state a cascade settles in."""
    out = []
    for flat in sos:
        coef = np.asarray(flat, dtype=float).reshape(-1, 5)
        level, states = 1.0, []
        for b0, b1, b2, a1, a2 in coef:
            gain = (b0 + b1 + b2) / (1.0 + a1 + a2)
            z2 = b2 - a2 * gain
            states += [(b1 - a1 * gain + z2) * level, z2 * level]
            level *= gain
        out.append(states)
    return pd.Series(out)


settled_state = F.pandas_udf(_settled, T.ArrayType(T.DoubleType()))


def _edge(sos: Column) -> Column:
    """Length of the mirrored edge: three times the number of taps of the cascade."""
    sections = (F.size(sos) / 5).cast("int")
    at = lambda offset: F.size(
        F.filter(F.sequence(F.lit(1), sections), lambda s: F.element_at(sos, s * 5 - offset) == 0.0)
    )
    return (sections * 2 + 1 - F.least(at(2), at(0))) * 3


def zero_phase_blocks(blocks: DataFrame, keys: Sequence[str], sos: Column, fanout: int = FANOUT) -> DataFrame:
    """Forward and backward cascade over (keys..., block_no, start_i, samples), with mirrored (odd) edges and settled
    start states, so the result has no phase shift. An edge longer than the signal allows is shortened to the signal.

    Only the blocks that hold an edge are brought together to mirror it; the others are never regrouped. The backward
    pass is the same cascade over reversed blocks in reversed order.
    """
    keys = list(keys)
    base = blocks.select(*keys, F.col("block_no").cast("long").alias("block_no"), "start_i", F.col("samples").cast(_STATE).alias("samples"))
    sized = base.groupBy(*keys).agg(F.max(F.col("start_i") + F.size("samples")).alias("_n"), F.max("block_no").alias("_last"))
    sized = sized.withColumn("sos", sos)
    sized = sized.withColumn("_e", F.least(_edge(F.col("sos")).cast("long"), F.col("_n") - 1).cast("int"))
    sized = sized.withColumn("_unit", settled_state("sos"))
    cut = base.join(sized, keys)
    head, tail = F.col("start_i") <= F.col("_e"), F.col("start_i") + F.size("samples") >= F.col("_n") - 1 - F.col("_e")
    ends = lambda here: F.flatten(F.array_sort(F.collect_list(F.when(here, F.struct("start_i", "samples"))))["samples"])
    edges = cut.where(head | tail).groupBy(*keys).agg(F.first("_e").alias("_w"), ends(head).alias("_h"), ends(tail).alias("_t"))
    mirror = lambda far, at: F.transform(far, lambda x: at * 2.0 - x)
    edges = edges.withColumns({"_v0": F.col("_h")[0], "_t": F.slice("_t", -F.col("_w") - 1, F.col("_w") + 1)}).select(
        *keys,
        F.reverse(mirror(F.slice("_h", F.lit(2), F.col("_w")), F.col("_v0"))).alias("_before"),
        F.reverse(mirror(F.slice("_t", F.lit(1), F.col("_w")), F.element_at("_t", -1))).alias("_after"),
    )
    none = F.array().cast(_STATE)
    first, last = F.col("block_no") == 0, F.col("block_no") == F.col("_last")
    wide = cut.join(edges, keys).withColumn(
        "samples", F.concat(F.when(first, F.col("_before")).otherwise(none), "samples", F.when(last, F.col("_after")).otherwise(none))
    ).drop("_before", "_after")

    def one_way(series: DataFrame) -> DataFrame:
        lead = F.col("samples")[0]
        started = series.withColumn("_z", F.when(F.col("block_no") == 0, F.transform("_unit", lambda z: z * lead)))
        return cascade(started, keys, fanout, initial="_z")

    turned = lambda series: series.withColumns({"samples": F.reverse("samples"), "block_no": F.col("_last") - F.col("block_no")})
    # Each pass reads its input twice; ``sos`` and ``_unit`` come back from the table of series.
    forward = turned(one_way(wide)).drop("_unit", "_n", "_e", "_last")
    forward = materialise(forward, "forward").join(sized, keys)
    back = turned(one_way(forward))
    begin = F.when(first, F.col("_e")).otherwise(0) + 1
    count = F.size("samples") - F.when(first, F.col("_e")).otherwise(0) - F.when(last, F.col("_e")).otherwise(0)
    return back.select(*keys, "block_no", "start_i", F.slice("samples", begin, count).alias("samples"))


def zero_phase(
    samples: DataFrame, keys: Sequence[str], sos: Column, block: int = 4096, fanout: int = FANOUT
) -> DataFrame:
    """``zero_phase_blocks`` of rows (keys..., i, v)."""
    return from_blocks(zero_phase_blocks(to_blocks(samples, keys, block), keys, sos, fanout), keys)
