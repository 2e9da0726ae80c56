"""Spectra, rate conversion, curves and bass management on known signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.functions import bands
from lowtide.operators import channels as M
from lowtide.operators import curves as C
from lowtide.operators import resample as RS
from lowtide.operators import samples as S
from lowtide.operators import spectral as P
from lowtide.operators import stats as A


def blocks_of(spark, x, fs, block):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "signal_id string, i long, v double")
    return S.to_blocks(df, ["signal_id"], block).withColumn("fs", F.lit(fs)).withColumn("n", F.lit(len(x)).cast("long"))


def test_sine_level(spark):
    """A full-scale sine on a bin shows 3 dB over the reference on every spectrum."""
    fs, f = 1000, 50.78125  # 52 * 1000 / 1024
    x = np.sin(2 * np.pi * f * np.arange(8192) / fs)
    b = blocks_of(spark, x, fs, 777)
    for curve in (P.avg_spectrum, P.median_spectrum, P.peak_spectrum):
        top = curve(b, ["signal_id"]).orderBy(F.desc("db")).first()
        assert top.f == pytest.approx(f)
        if curve is not P.median_spectrum:
            assert top.db == pytest.approx(10 * math.log10(0.5) + 6.0206, abs=0.01)
    low = P.avg_spectrum(b, ["signal_id"]).agg(F.min("db"), F.max("db")).first()
    assert low[1] - low[0] <= 80.0 + 1e-9


def test_frames_do_not_depend_on_blocks(spark):
    x = np.random.default_rng(5).normal(size=1000)
    a = P.frames(blocks_of(spark, x, 64, 64), ["signal_id"], 128).toPandas().sort_values("frame")
    b = P.frames(blocks_of(spark, x, 64, 11), ["signal_id"], 128).toPandas().sort_values("frame")
    assert len(a) == (1000 - 128) // 64 + 1
    for k, (p, q) in enumerate(zip(a["x"], b["x"])):
        assert np.allclose(p, q) and np.allclose(p, x[k * 64:k * 64 + 128])


def test_segments_are_padded(spark):
    x = np.random.default_rng(6).normal(size=1001)
    f = P.frames(blocks_of(spark, x, 64, 100), ["signal_id"], 50, segment_limit=400).toPandas()
    assert set(f["seg"]) == {0, 1, 2}
    last = f[(f.seg == 2)].sort_values("frame").iloc[-1]
    assert len(last["x"]) == 50


@pytest.mark.parametrize("fs,new_fs", [(4000, 1000), (4410, 1000), (1000, 2000)])
def test_resample_tone(spark, fs, new_fs):
    n, f = 4000, 37.0
    x = np.sin(2 * np.pi * f * np.arange(n) / fs)
    out = RS.resample(blocks_of(spark, x, fs, 333), ["signal_id"], fs, new_fs, block=128)
    y = S.from_blocks(out, ["signal_id"]).toPandas().sort_values("i")["v"].to_numpy()
    assert len(y) == math.ceil(n * new_fs / fs)
    want = np.sin(2 * np.pi * f * np.arange(len(y)) / new_fs)
    edge = 140 * max(1, new_fs // fs)
    assert np.abs(y - want)[edge:-edge].max() < 1e-4
    again = RS.resample(blocks_of(spark, x, fs, 1000), ["signal_id"], fs, new_fs, block=500)
    z = S.from_blocks(again, ["signal_id"]).toPandas().sort_values("i")["v"].to_numpy()
    assert np.allclose(y, z, atol=1e-12)


def test_resample_removes_what_does_not_fit(spark):
    x = np.sin(2 * np.pi * 900 * np.arange(8000) / 4000)
    out = RS.resample(blocks_of(spark, x, 4000, 1000), ["signal_id"], 4000, 1000)
    y = S.from_blocks(out, ["signal_id"]).toPandas().sort_values("i")["v"].to_numpy()
    assert np.abs(y[200:-200]).max() < 1e-4


def test_worst_case_headroom(spark):
    df = spark.createDataFrame([("WCS", 6), ("WCS", 8), ("-7.5", 6)], "k string, n int")
    got = [r.h for r in df.select(M.headroom_db(F.col("k"), F.col("n")).alias("h")).collect()]
    assert got == [pytest.approx(18.2362, abs=1e-4), pytest.approx(20.1398, abs=1e-4), 17.5]


def test_nominal_bands(spark):
    df = spark.createDataFrame([(3, n) for n in (-18, -20, 0, 13)] + [(1, 0), (1, -6)], "fraction int, n int")
    got = [r.x for r in df.select(bands.nominal(F.col("n"), F.col("fraction")).alias("x")).collect()]
    assert got == [16.0, 10.0, 1000.0, 20000.0, 1000.0, 16.0]


def test_uneven_grid(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, 0.0), ("b", 2.0, 0.0), ("b", 4.0, 0.0)], "c string, f double, db double")
    assert [r.c for r in C.uneven(df, ["c"]).collect()] == ["b"]


def test_interpolation_runs_on(spark):
    curve = spark.createDataFrame([("a", float(k), float(k * k)) for k in range(1, 6)], "c string, f double, db double")
    grid = spark.createDataFrame([("a", 0.0), ("a", 3.0), ("a", 2.5), ("a", 9.0)], "c string, f double")
    held = {r.f: r.db for r in C.interpolate(curve, grid, ["c"], smooth=False).collect()}
    assert held == {0.0: 1.0, 3.0: 9.0, 2.5: 6.5, 9.0: 25.0}
    cubic = {r.f: r.db for r in C.interpolate(curve, grid, ["c"]).collect()}
    assert cubic[3.0] == 9.0 and 4.0 < cubic[2.5] < 9.0
    assert cubic[9.0] != 25.0


@pytest.mark.parametrize("kind", ["SG", "SG/11/3"])
def test_polynomial_is_kept(spark, kind):
    y = lambda x: 1 + 0.5 * x - 0.01 * x ** 2
    curve = spark.createDataFrame([("a", float(k), float(y(k))) for k in range(150)], "c string, f double, db double")
    for r in C.smooth_polynomial(curve, ["c"], kind).collect():
        assert r.db == pytest.approx(y(r.f), abs=1e-6)


def test_rescale_grid(spark):
    curve = spark.createDataFrame([("a", float(k), float(k)) for k in range(11)], "c string, f double, db double")
    out = C.rescale(curve, ["c"], points=50).toPandas().sort_values("f")
    assert np.allclose(out["f"], np.arange(50) * 0.2) and np.allclose(out["db"], out["f"])


def test_hms(spark):
    got = [r.t for r in spark.createDataFrame([(3725.0,), (59.5,), (0.0,)], "s double").select(A.hms(F.col("s")).alias("t")).collect()]
    assert got == ["1:02:05", "0:00:59.500000", "0:00:00"]


def test_gain_there_and_back(spark):
    df = spark.createDataFrame([("a", i, float(v), 64) for i, v in enumerate(np.linspace(-1, 1, 50))], "signal_id string, i long, v double, fs int")
    back = S.offset(S.offset(df, 4.5), -4.5).toPandas().sort_values("i")["v"]
    assert np.allclose(back, np.linspace(-1, 1, 50))


def test_shift_beyond_the_end(spark):
    df = spark.createDataFrame([("a", i, 1.0, 64) for i in range(10)], "signal_id string, i long, v double, fs int")
    out = S.shift(df, ["signal_id"], 1000.0).toPandas()
    assert sorted(out["i"]) == list(range(10)) and (out["v"] == 0).all()


def test_silent_window(spark):
    df = spark.createDataFrame([("a", i, 0.0, 64) for i in range(10)], "signal_id string, i long, v double, fs int")
    assert {r.db for r in A.windowed_peaks(df, ["signal_id"]).collect()} == {-120.0}


def test_pulse(spark):
    p = S.pulse(spark, 10).toPandas().sort_values("i")
    assert len(p) == 40 and p["v"].to_numpy()[20] == 1.0 and p["v"].sum() == 1.0


def test_spectra_evaluate_their_transform_once(spark):
    blocks = blocks_of(spark, np.sin(np.arange(3000) / 5), 500, 256)
    cells = P.spectrogram(blocks, ["signal_id"])
    for df, most in ((P.avg_spectrum(blocks, ["signal_id"]), 1), (P.peak_spectrum(blocks, ["signal_id"]), 1), (cells, 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == most


def test_operations_fold_into_one_pass(spark):
    """Delays and advances one after the other lose what leaves the signal, however many there are."""
    x = np.arange(1.0, 13.0)
    rows = [("t", c, i, float(v), 1000) for c in ("FL", "FR", "BR") for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "title string, channel string, i long, v double, fs int")
    ops = [
        {"kind": "delay", "channels": ["FL"], "value": 4.0}, {"kind": "gain", "channels": ["FL", "FR"], "value": 20.0},
        {"kind": "delay", "channels": ["FL", "FR"], "value": -6.0}, {"kind": "polarity", "channels": ["FR"]},
        {"kind": "delay", "channels": ["FL"], "value": 3.0}, {"kind": "delay", "channels": ["FL"], "value": 99.0, "enabled": False},
        {"kind": "delay", "channels": ["BR"], "value": 40.0},
    ]

    def moved(v, by):
        out = np.zeros_like(v)
        if abs(by) < len(v):
            out[max(by, 0):len(v) + min(by, 0)] = v[max(-by, 0):len(v) - max(by, 0)]
        return out

    want = {"FL": moved(moved(moved(x, 4), -6), 3) * 10, "FR": -moved(x, -6) * 10, "BR": np.zeros(12)}
    out = M.apply_ops(samples, ops)
    got = out.toPandas().sort_values("i")
    for c, v in want.items():
        mine = got[got.channel == c]
        assert mine["i"].tolist() == list(range(12)) and np.allclose(mine["v"], v)
    few, many = M.apply_ops(samples, ops[:1]), M.apply_ops(samples, ops * 5)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    assert scans(many) == scans(few)
