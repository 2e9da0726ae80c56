"""Energies and peaks beside blocks against the samples, and the meter with state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.operators import pyramid as P
from lowtide.operators import samples as S
from lowtide.operators import stats as A
from lowtide.streaming import meter as V


def test_tree_answers_every_range_from_few_entries():
    r = np.random.default_rng(3)
    for n in [*range(1, 40), 64, 100]:
        x = r.normal(size=n)
        tree = P.peak_tree(x)
        assert len(tree) < 2 * n + 8
        for low in range(n):
            for high in range(low + 1, n + 1):
                asked = []
                got = P.tree_peak(tree, n, low, high, lambda i: asked.append(i) or abs(x[i]))
                assert got == np.abs(x[low:high]).max() and len(asked) <= 2


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(11)
    data = [(s, i, 0.0 if s == "silent" else r.uniform(-1, 1) * (i % 50 < 20), 64) for s, n in {"a": 1, "b": 64, "c": 333, "silent": 70}.items() for i in range(n)]
    return spark.createDataFrame(data, "signal_id string, i long, v double, fs int").cache()


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_windows_and_levels(rows, block):
    blocks = P.with_pyramid(S.to_blocks(rows, ["signal_id", "fs"], block).withColumn("energy", F.lit("replaced")))
    times = {"short": 0.05, "middle": 0.5, "long": 3.0, "whole": 100.0}
    told = lambda df: {(r.signal_id, r.kind): pytest.approx(r.db, abs=1e-9) for r in df.collect()}
    assert told(P.windowed_peaks(blocks, ["signal_id"], times)) == {(r.signal_id, r.kind): r.db for r in A.windowed_peaks(rows, ["signal_id"], times).collect()}
    names = ["rms_db", "peak_db", "crest_db", "headroom_db"]
    loud = "signal_id <> 'silent'"
    got = {r.signal_id: [pytest.approx(r[c], abs=1e-9) for c in names] for r in P.levels(blocks.where(loud), ["signal_id"]).collect()}
    assert got == {r.signal_id: [r[c] for c in names] for r in A.levels(rows.where(loud), ["signal_id"]).collect()}


def test_stretches(spark, rows):
    blocks = P.with_pyramid(S.to_blocks(rows, ["signal_id", "fs"], 16))
    r = random.Random(1)
    asked = {(s, low, low + r.randint(0, 200)) for s in ("a", "c", "silent", "unknown") for low in (0, 1, 15, 16, 17, 69, 300, 400)}
    got = {(x.signal_id, x.low, x.high): (x.rms_db, x.peak_db) for x in P.range_levels(blocks, spark.createDataFrame(sorted(asked), "signal_id string, low long, high long"), ["signal_id"], 16).collect()}
    values = {}
    for x in rows.collect():
        values.setdefault(x.signal_id, {})[x.i] = x.v
    for key in asked:
        part = np.array([v for i, v in values.get(key[0], {}).items() if key[1] <= i < key[2]])
        if not len(part):
            assert key not in got
        elif not part.any():
            assert got[key] == (-120.0, -120.0)
        else:
            assert got[key] == pytest.approx((10 * np.log10((part**2).mean()), 20 * np.log10(np.abs(part).max())))


def test_an_idle_signal_is_forgotten(spark, tmp_path):
    day = 86400
    batches = [
        [("a", 0, 0.5), ("a", 10, 1.0), ("b", 20, 0.25), ("a", 3700, 0.1)],
        [("a", 2 * 3600, 0.25), ("b", 4 * day, 0.5)],
        [("b", 8 * day, 0.75)],
        [("a", 9 * day, 0.125), ("b", 9 * day, 0.5)],
        [("b", 12 * day, 0.5)],
    ]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*V.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, "signal_id string, t long, v double").select("signal_id", F.timestamp_seconds(F.col("t") + 1000 * day).alias("ts"), "v")
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
            V.run_to_table(V.loudest_windows(stream, "1 hour", "1 hour", "2 days"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.unset(V.STATE_STORE[0])
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    got = {(r.signal_id, int(r.start.timestamp()) // 3600 - 24_000): (r.n, r.loudest_db) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    db = lambda *v: pytest.approx(10 * np.log10(np.mean(np.square(v))))
    assert got[("a", 0)] == (2, db(0.5, 1.0)) and got[("a", 1)] == (1, db(0.5, 1.0)) and got[("a", 2)] == (1, db(0.5, 1.0))
    assert got[("a", 9 * 24)] == (1, db(0.125))  # begun anew
    assert got[("b", 4 * 24)] == (1, db(0.5)) and got[("b", 8 * 24)] == (1, db(0.75))
