"""Coefficients, cascades and formats against known values and plain numpy."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lowtide.functions import biquad, text
from lowtide.functions.tables import bessel_rows
from lowtide.operators import filters as O
from lowtide.operators import recursive as R
from lowtide.operators import samples as S

DESIGN = [("LowShelf", 20.0, 0.7, 6.0), ("PeakingEQ", 40.0, 1.2, -4.5), ("HighShelf", 120.0, 0.9, 2.0)]


def sections(spark, design, fs):
    row = spark.range(1).select(R.flat_sos(biquad.design(design, fs)).alias("s")).first()
    return np.array(row.s).reshape(-1, 5)


def sequential(x, sos, state=None):
    y = np.asarray(x, dtype=float)
    for j, (b0, b1, b2, a1, a2) in enumerate(sos):
        z1, z2 = (0.0, 0.0) if state is None else state[j]
        out = np.empty_like(y)
        for t, v in enumerate(y):
            out[t] = b0 * v + z1
            z1, z2 = b1 * v - a1 * out[t] + z2, b2 * v - a2 * out[t]
        y = out
    return y


def test_linkwitz_transform_values(spark):
    lit = F.lit
    got = spark.range(1).select(biquad.linkwitz_transform(lit(48000), lit(50.0), lit(1.0), lit(35.0), lit(0.707)).alias("s")).first().s
    assert got.a1 == pytest.approx(-1.993519840635900, rel=1e-12)
    assert got.a2 == pytest.approx(0.993540762888275, rel=1e-12)
    assert got.b0 == pytest.approx(1.000037740241020, rel=1e-12)
    assert got.b1 == pytest.approx(-1.993508952524960, rel=1e-12)
    assert got.b2 == pytest.approx(0.993513910758182, rel=1e-12)


def test_bessel_values():
    rows = {(f, o, s): (q, m) for f, o, s, q, m in bessel_rows()}
    assert rows["BESP", 2, 0] == (pytest.approx(0.57735026919), pytest.approx(1.0))
    assert rows["BESP", 8, 1] == (pytest.approx(0.710852074442), pytest.approx(1.01102810214))
    assert rows["BESM3", 2, 0][1] == pytest.approx(1.27201964951)
    assert rows["BESM3", 12, 0] == (pytest.approx(1.59465693507), pytest.approx(2.69298925084))
    assert rows["BESM6", 1, 0] == (None, pytest.approx(0.5791803096))
    assert rows["BESM6", 20, 9][0] == pytest.approx(0.501021580965, rel=1e-6)


def test_pass_filter_levels(spark):
    """Butterworth and Bessel -3 dB are 3 dB down at the corner, Linkwitz-Riley 6 dB."""
    rows = [(o, 0, "low", fam, o, 48000, 100.0, 0.5 ** 0.5) for o in (2, 3, 4, 7, 8) for fam in ("BW", "BESM3")]
    rows += [(100 + o, 0, "high", "LR", o, 48000, 100.0, 0.5 ** 0.5) for o in (4, 8, 12)]
    df = spark.createDataFrame(rows, "filter_set_id long, seq long, side string, family string, order int, fs int, freq double, q double")
    secs = O.with_sections(O.pass_sections(df).withColumn("gain", F.lit(0.0)))
    w = F.lit(2 * math.pi * 100.0 / 48000)
    got = secs.groupBy("filter_set_id", "family").agg(F.sum(biquad.response_db(F.col("sos"), w)).alias("db")).collect()
    for r in got:
        assert r.db == pytest.approx(-6.0206 if r.family == "LR" else -3.0103, abs=0.02), r
    assert O.pass_sections(spark.createDataFrame([(1, 0, "low", "LR", 3, 48000, 100.0, 0.7)], df.schema)).count() == 0


@pytest.mark.parametrize("block,fanout,tiers", [(1, 4, 3), (7, 3, 3), (64, 2, 2), (500, 1024, 1)])
def test_cascade_equals_sequential(spark, block, fanout, tiers):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=500), "b": rng.normal(size=333), "c": rng.normal(size=1)}
    rows = [(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "signal_id string, i long, v double")
    blocks = S.to_blocks(df, ["signal_id"], block).withColumn("sos", R.flat_sos(biquad.design(DESIGN, 1000)))
    got = S.from_blocks(R.cascade(blocks, ["signal_id"], fanout, tiers), ["signal_id"]).toPandas()
    sos = sections(spark, DESIGN, 1000)
    for k, xs in x.items():
        mine = got[got.signal_id == k].sort_values("i")["v"].to_numpy()
        assert np.allclose(mine, sequential(xs, sos), atol=1e-10)


def test_zero_phase_matches_plain(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "signal_id string, i long, v double")
    got = R.zero_phase(df, ["signal_id"], R.flat_sos(biquad.design(DESIGN, 1000)), block=17, fanout=3).toPandas().sort_values("i")
    sos = sections(spark, DESIGN, 1000)
    e = 3 * (2 * len(sos) + 1)
    ext = np.concatenate([2 * x[0] - x[e:0:-1], x, 2 * x[-1] - x[-2:-e - 2:-1]])

    def run(s):
        level, start = s[0], []
        for b0, b1, b2, a1, a2 in sos:
            g = (b0 + b1 + b2) / (1 + a1 + a2)
            z2 = b2 - a2 * g
            start.append(((b1 - a1 * g + z2) * level, z2 * level))
            level *= g
        return sequential(s, sos, start)

    want = run(run(ext)[::-1])[::-1][e:-e]
    assert np.allclose(got["v"], want, atol=1e-9)


def test_linear_and_identity(spark):
    up, down = [("PeakingEQ", 40.0, 1.0, 6.0)], [("PeakingEQ", 40.0, 1.0, -6.0)]
    x = np.random.default_rng(3).normal(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "signal_id string, i long, v double")
    blocks = S.to_blocks(df, ["signal_id"], 50).withColumn("sos", R.flat_sos(biquad.design(up + down, 1000)))
    got = S.from_blocks(R.cascade(blocks, ["signal_id"]), ["signal_id"]).toPandas().sort_values("i")["v"]
    assert np.allclose(got, x, atol=1e-9)


def test_reduce_shelves_keeps_total(spark):
    rows = [(1, 0, "LowShelf", 1000, 20.0, 0.8, 2.0, 4), (1, 1, "LowShelf", 1000, 30.0, 0.8, -1.0, 3), (1, 2, "PeakingEQ", 1000, 30.0, 0.8, 1.0, 1),
            (2, 0, "LowShelf", 1000, 20.0, 0.8, 2.0, 4)]
    df = spark.createDataFrame(rows, "filter_set_id long, seq long, kind string, fs int, freq double, q double, gain double, n int")
    got = {(r.filter_set_id, r.seq): r for r in O.reduce_shelves(df, 5).collect()}
    assert sum(r.n for r in got.values() if r.filter_set_id == 1) == 5
    assert got[1, 0].n * got[1, 0].gain == pytest.approx(8.0)
    assert got[2, 0].n == 4 and got[2, 0].saved == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e12, max_value=1e12, allow_nan=False).filter(lambda v: v == 0 or abs(v) > 1e-12), min_size=20, max_size=60))
def test_number_formats(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(float(v) + 0.0,) for v in values], "v double")
    got = df.select("v", text.general(F.col("v"), 6).alias("g"), text.float_hex(F.col("v")).alias("h")).collect()
    for r in got:
        assert float(r.g) == pytest.approx(float(f"{r.v:.6g}"), rel=2e-6)
        assert len(r.g) <= len(f"{r.v:.6g}") + 1
        assert r.h == f"{struct.unpack('<I', struct.pack('<f', r.v))[0]:08x}"


def test_fixed_text(spark):
    values = [1.0, 0.5, -0.25, 1.2345678, -1.9999]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.fixed_hex(F.col("v")).alias("h")).collect()]
    want = [f"{(int(-v * 2 ** 23) ^ 0xFFFFFFF) if v < 0 else int(v * 2 ** 23):08x}" for v in values]
    assert got == want


def test_filter_documents(spark):
    from lowtide.sinks.exports import filter_json
    from lowtide.sources.documents import filter_rows

    rows = [("PeakingEQ", 48000, 100.0, 0.707, 4.3, 1), ("LowShelf", 48000, 20.0, 1.5, 2.5, 1), ("Gain", 1000, None, None, 10.0, 1), ("Passthrough", 1000, None, None, None, 1)]
    df = spark.createDataFrame(rows, "kind string, fs int, freq double, q double, gain double, n int")
    got = [json.loads(r.j) for r in df.select(filter_json(F.col("kind")).alias("j")).collect()]
    assert got[0] == {"_type": "PeakingEQ", "fs": 48000, "fc": 100.0, "q": 0.707, "gain": 4.3}
    assert got[1] == {"_type": "LowShelf", "fs": 48000, "fc": 20.0, "q": 1.5, "gain": 2.5, "count": 1}
    assert got[2] == {"_type": "Gain", "fs": 1000, "gain": 10.0}
    assert got[3] == {"_type": "Passthrough", "fs": 1000}
    docs = spark.createDataFrame([
        ("a", '{"_type": "CompleteFilter", "description": "x", "fs": 2000, "filters": [{"_type": "ComplexLowPass", "filter_type": "LR", "order": 4, "fs": 2000, "fc": 80.0}, {"_type": "FirstOrder_HighPass", "fc": 10.0}]}'),
        ("b", '{"_type": "Mystery", "fs": 1}'),
    ], "id string, content string")
    out = {(r.id, r.seq): r for r in filter_rows(docs).collect()}
    assert (out["a", 0].kind, out["a", 0].family, out["a", 0].order) == ("ComplexLowPass", "LR", 4)
    assert (out["a", 1].kind, out["a", 1].fs) == ("HighPass1", 2000)
    assert out["b", 0].kind is None and out["b", 0].type == "Mystery"


def test_response_of_a_large_set(spark):
    """A set of many sections, split in pieces, equals the sum of its filters."""
    df = spark.range(300).select(
        F.lit(1).alias("filter_set_id"), F.col("id").alias("seq"), F.lit("PeakingEQ").alias("kind"), F.lit(1000).alias("fs"),
        (F.col("id") + 5.0).alias("freq"), F.lit(1.1).alias("q"), (F.col("id") % 7 - 3.0).alias("gain"), F.lit(1).alias("n"),
    ).unionByName(spark.createDataFrame([(2, 0, "LowShelf", 1000, 20.0, 0.7, 3.0, 2)], "filter_set_id int, seq long, kind string, fs int, freq double, q double, gain double, n int"))
    got = O.response(df, 1500)
    each = O.response(df, 1500, by=["filter_set_id", "seq"]).groupBy("filter_set_id", "k").agg(F.sum("db").alias("want"))
    both = got.join(each, ["filter_set_id", "k"])
    assert both.count() == 3000
    assert both.where("abs(db - want) > 1e-8 or phase <= -180 or phase > 180").count() == 0
    assert got.where("filter_set_id = 2 and k = 0").first().db == pytest.approx(6.0)


def test_pass_filters_are_expanded_or_rejected(spark):
    rows = [("low", "BW", 3), ("low", "LR", 4), ("low", "LR", 3), ("high", "BESP", 26), ("high", "BESM6", 25), ("low", "BW", 0), ("low", "XX", 2), ("low", None, 2)]
    df = spark.createDataFrame([(*r, 48000, 100.0, 0.7071) for r in rows], "side string, family string, order int, fs int, freq double, q double")
    bad = {(r.family, r.order): r.reason for r in O.rejected_passes(df).collect()}
    assert set(bad) == {("LR", 3), ("BESP", 26), ("BW", 0), ("XX", 2), (None, 2)}
    good = {(r.family, r.order) for r in O.pass_sections(df).collect()}
    assert good | set(bad) == {(f, n) for _, f, n in rows} and not good & set(bad)


def test_empty_sets_pass_through(spark):
    rows = [("a", i, "PeakingEQ", 1000, 50.0, 1.0, 0.05, 1) for i in range(150)]
    df = spark.createDataFrame(rows, "filter_set_id string, seq int, kind string, fs int, freq double, q double, gain double, n int")
    sets = spark.createDataFrame([("a", 1000), ("b", 1000)], "filter_set_id string, fs int")
    got = O.response(df, 64, sets=sets).toPandas()
    assert len(got) == 128
    assert np.allclose(got[got.filter_set_id == "b"][["db", "phase"]], 0.0)
    one = O.response(df.where("seq = 0"), 64).toPandas().sort_values("k")["db"].to_numpy()
    assert np.allclose(got[got.filter_set_id == "a"].sort_values("k")["db"], 150 * one)


def test_too_many_device_filters_have_no_slot(spark):
    rows = [(s, i, "PeakingEQ", 96000, 20.0 + i, 1.0, 1.0, 1) for s, n in (("fits", 16), ("over", 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "filter_set_id string, seq int, kind string, fs int, freq double, q double, gain double, n int")
    got = O.slot_placement(df).toPandas()
    assert sorted(got[got.filter_set_id == "fits"]["slot"]) == list(range(16)) and got[got.filter_set_id == "over"]["slot"].isna().all()
