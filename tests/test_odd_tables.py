"""Registered queries beside their SQL on tables with odd values: silence, overload, ties and short or crowded groups."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lowtide.functions.text import to_places
from lowtide.plans import ORACLES, QUERIES
from tests.check import compare


def _events():
    """User 0 is loud, 1 is short, 2 and 3 cancel out, 4 has hours of silence."""
    r = random.Random(5)
    value = {
        0: lambda i: 600.0 if i == 9 else -600.0 if i == 12 else round(r.random() * 100, 2),
        1: lambda i: round(r.random() * 100, 2),
        2: lambda i: 50.0 + (i % 2 * 2 - 1) * (i // 2 % 7 + 0.01),
        3: lambda i: 50.07 if i % 2 else 49.93,
        4: lambda i: 50.5 if i % 3 else 61.25,
    }
    for user, many in enumerate((100, 25, 84, 64, 70)):
        for i in range(many):
            yield user * 1000 + i, 1704067200 + i * 5000 + user, user, value[user](i)


def _parts():
    """Sets of shelves only: without gain, with equal gains, and with more copies than a device has slots."""
    for key in range(64):
        kind = "SMALL" if key < 32 else ("SMALL", "ECONOMY", "MEDIUM")[key % 3]
        yield key, "part", "Brand", kind, key % 20 + 1, 950.0 + (0.0 if key < 8 else 40.0 if key < 24 else (key % 4) * 10.0)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    events = spark.createDataFrame(list(_events()), "event_id long, t long, user_id long, value double")
    events.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    parts = spark.createDataFrame(list(_parts()), "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    vectors = [(k, k % 2, [(j - 32 + 64 * k) / 128 for j in range(64)]) for k in range(4)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in ("events", "part", "embeddings"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return folder, con


NAMES = (
    "device_slots impulse_response_curves live_levels live_loudest window_levels read_wav read_wav_range read_wav_source load_channel "
    "load_channel_resampled load_composite load_signals reduced_shelves response_text visible_slice_spectrum "
    "filter_impulse_response routed_samples player_pass_rows parsed_equaliser_text equaliser_text"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    folder, con = odd
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], folder)
    assert ok, message


def test_shelves_without_gain_are_merged(spark, odd):
    rows = [r for r in QUERIES["reduced_shelves"](spark, odd[0]).collect() if r.filter_set_id == 0]
    assert sum(r.n for r in rows) == 8 and sum(r.saved for r in rows) == 7  # a shelf keeps one copy


def test_silence_has_a_level(spark, odd):
    rows = QUERIES["window_levels"](spark, odd[0]).where("signal_id = 's4'").collect()
    assert {r.rms_db for r in rows if r.rms_db < -100} == {float("-inf")}


def test_places_as_c_prints_them(spark):
    r = random.Random(2)
    values = [0.3125, 0.0625, -0.1875, 1.0005, 2.0015, -0.0, 0.0, -0.0004, 0.9995, 1e15 + 0.5, 12345.6785, 1 / 3]
    values += [r.randint(-10**7, 10**7) / 1e4 for _ in range(2000)] + [r.randint(-10**5, 10**5) / 16 for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.format_string("%8.3f", to_places(F.col("v"))).alias("t")).collect()
    assert [(x.v, x.t) for x in got] == [(x.v, "%8.3f" % x.v) for x in got]
