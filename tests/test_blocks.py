"""Block operators against the ones on rows."""

import random

import pytest
from pyspark.sql import functions as F

from lowtide.operators import blocks as B
from lowtide.operators import channels as M
from lowtide.operators import samples as S

LENGTHS = {"a": 1, "b": 16, "c": 17, "d": 53, "e": 200}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    data = [(s, i, r.uniform(-1, 1), 8) for s, n in LENGTHS.items() for i in range(n)]
    return spark.createDataFrame(data, "signal_id string, i long, v double, fs int").cache()


@pytest.fixture(scope="module")
def blocks(rows):
    return S.to_blocks(rows, ["signal_id", "fs"], 16).cache()


def _set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("ms", [0.0, 125.0, 2000.0, 2250.0, 7000.0, 1e6, -125.0, -2125.0, -6500.0, -1e6])
def test_shift(rows, blocks, ms):
    out = B.shift(blocks, ["signal_id"], ms, 16)
    assert _set(S.from_blocks(out, ["signal_id"]), "signal_id", "i", "v") == _set(S.shift(rows, ["signal_id"], ms), "signal_id", "i", "v")
    assert {r.start_i % 16 for r in out.collect()} == {0}


@pytest.mark.parametrize("start, end", [(0.0, 1.0), (1.9, 2.0), (2.0, 6.3), (0.0, 0.1), (5.0, 50.0)])
def test_cut(rows, blocks, start, end):
    out = B.cut(blocks, ["signal_id"], start, end)
    assert _set(S.from_blocks(out, ["signal_id"]), "signal_id", "i", "v") == _set(S.cut(rows, ["signal_id"], start, end), "signal_id", "i", "v")


def test_concatenate_has_no_rows_of_samples(spark, rows, blocks):
    plan = spark.createDataFrame([(s, "one" if s in "ace" else "two", k) for k, s in enumerate(LENGTHS)], "signal_id string, merged_id string, ord int")
    out = B.concatenate(blocks, "signal_id", plan, block=16)
    want = S.concatenate(rows, "signal_id", plan)
    assert _set(S.from_blocks(out, ["merged_id"]), "merged_id", "i", "v") == _set(want, "merged_id", "i", "v")
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(len(r.samples) == min(16, r.n - r.start_i) for r in out.collect())


def test_channels_that_end_early(spark):
    r = random.Random(9)
    sizes = {("t", "FL"): 40, ("t", "FC"): 55, ("t", "LFE"): 3, ("u", "FC"): 20, ("w", "FL"): 8}
    rows = spark.createDataFrame([(t, c, i, r.uniform(-1, 1), 8) for (t, c), n in sizes.items() for i in range(n)], "title string, channel string, i long, v double, fs int")
    blocks = S.to_blocks(rows, ["title", "channel", "fs"], 16)
    near = lambda df: {(r.title, r.channel, r.i): pytest.approx(r.v, abs=1e-12) for r in df.collect()}
    for mode in ("add", "subtract", "copy", "move", "swap"):
        got = S.from_blocks(B.mix(blocks, mode, "FC", "FL", -6.0), ["title", "channel"])
        assert near(got) == {(r.title, r.channel, r.i): r.v for r in M.mix(rows, mode, "FC", "FL", -6.0).collect()}
    mono = S.from_blocks(B.mono_mix(blocks), ["title", "channel"])
    assert near(mono) == {(r.title, "mono", r.i): r.v for r in M.mono_mix(rows).collect()}
    with pytest.raises(ValueError):
        B.mix(blocks, "turn", "FC", "FL")
