"""Positions, running sums and quantiles with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.operators.ordering import exact_quantile, running_sum, with_group_agg, with_position


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17)
    return spark.range(20000).select(
        key.alias("k"), F.xxhash64("id").alias("o"), (F.col("id") % 7).cast("double").alias("same"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 1000003 / 1000.0 - 400.0).alias("v"),
    )


def test_position(skewed):
    got = with_position(skewed, ["k"], ["o"]).toPandas()
    want = skewed.toPandas()
    want["i"] = want.groupby("k")["o"].rank(method="first").astype(int) - 1
    joined = got.merge(want, on=["k", "o"])
    assert len(joined) == len(want)
    assert (joined["i_x"] == joined["i_y"]).all()


@pytest.mark.parametrize("block", [1, 37, 4096])
def test_running_sum(skewed, block):
    placed = with_position(skewed, ["k"], ["o"])
    got = running_sum(placed, ["k"], "i", F.col("v"), "s", block).toPandas().sort_values(["k", "i"])
    want = got.groupby("k")["v"].cumsum()
    assert np.allclose(got["s"], want, atol=1e-6)
    before = running_sum(placed, ["k"], "i", F.col("v"), "s", block, inclusive=False).toPandas().sort_values(["k", "i"])
    assert np.allclose(before["s"], want.to_numpy() - before["v"].to_numpy(), atol=1e-6)


@pytest.mark.parametrize("value", ["v", "same"])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantile(skewed, value, q):
    got = exact_quantile(skewed, ["k"], value, q, "x").toPandas().set_index("k")
    want = skewed.toPandas().groupby("k")[value]
    assert np.allclose(got["x"].sort_index(), want.quantile(q).sort_index())
    assert (got["n"].sort_index() == want.size().sort_index()).all()


def test_group_agg(skewed):
    out = with_group_agg(skewed, ["k"], top=F.max("v"))
    assert out.count() == 20000
    assert out.where("v > top").count() == 0


def test_quantile_of_one_octave_ranks_few_rows(spark):
    """One key, all values in one bin: what a window ranks stays far below the bin."""
    x = np.random.default_rng(5).uniform(1.0, 1.02, 60_000)
    df = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double")
    for q in (0.0, 0.25, 0.5, 0.999, 1.0):
        out = exact_quantile(df, ["k"], "v", q, "m")
        assert abs(out.first().m - np.quantile(x, q)) < 1e-12
    sizes = np.histogram(x, bins=4096, range=(x.min(), x.max()))[0]
    assert sizes.max() < 60
