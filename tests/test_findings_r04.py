"""Findings of round 4: small tables on which a query differed from its SQL, and failures that looked like results."""

import os
import random
import struct

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lowtide.plans import ORACLES, QUERIES
from lowtide.sources import wav_source as W


def _events(path, rows):
    """A table of (event_id, second, user_id, value)."""
    event, second, user, value = zip(*rows)
    ts = pa.array([(1704067200 + s) * 1_000_000 for s in second], pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": event, "ts": ts, "user_id": user, "value": value}), f"{path}/events.parquet")
    return str(path)


def _sql(folder, name, columns):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return con.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({ORACLES[name]}) order by all").fetchall()


def test_phase_of_negative_real_responses(spark, tmp_path):
    r = random.Random(3)
    rows = [(u * 100 + i, i * 4000, u, float(r.randint(49, 51))) for u in range(300) for i in range(1 + u % 100)]
    folder = _events(tmp_path, rows)
    ours = QUERIES["impulse_response_curves"](spark, folder)
    theirs = _sql(folder, "impulse_response_curves", ours.columns)
    assert {-180.0, 180.0} <= {row[3] for row in theirs}
    assert sorted(tuple(row) for row in ours.collect()) == theirs


METERS = ("window_levels", "live_levels", "live_loudest")


def _few(path):
    """Hours of three users around the change to summer time in New York: silence, one row without a value, an hour of
    such rows and one row that is no number."""
    r = random.Random(5)
    value = {4: 50.5, 5: 50.5, 17: None, 30: None, 31: None, 32: None, 33: None, 70: float("nan")}
    day = 69 * 86400
    rows = [(u * 100 + i, day + i * 900 + u, u, value.get(i, round(r.random() * 100, 2)) if u else 50.5) for u in range(3) for i in range(90)]
    return _events(path, rows)


def _same(spark, folder, name):
    ours = QUERIES[name](spark, folder)
    theirs = _sql(folder, name, ours.columns)
    text = lambda rows: sorted(str(tuple(row)) for row in rows)
    assert len(theirs) > 20 and text(ours.collect()) == text(theirs)
    return ours


@pytest.mark.parametrize("name", METERS)
def test_meters_in_another_zone(spark, tmp_path, name):
    folder = _few(tmp_path)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        _same(spark, folder, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name", METERS)
def test_meters_keep_the_type_of_times(spark, tmp_path, name):
    folder = _few(tmp_path)
    plain = pq.read_table(f"{folder}/events.parquet")
    pq.write_table(plain.set_column(1, "ts", plain["ts"].cast(pa.timestamp("us", "UTC"))), f"{folder}/events.parquet")
    types = dict(QUERIES[name](spark, folder).dtypes)
    assert types["start"] == types["end"] == "timestamp"


def test_rows_without_time_are_counted(spark, tmp_path):
    folder = _few(tmp_path)
    plain = pq.read_table(f"{folder}/events.parquet")
    ts = pa.array([None if i % 17 == 3 else t for i, t in enumerate(plain["ts"].to_pylist())], pa.timestamp("us"))
    pq.write_table(plain.set_column(1, "ts", ts), f"{folder}/events.parquet")
    assert _same(spark, folder, "window_levels").agg({"n": "sum"}).first()[0] == plain.num_rows


@pytest.fixture
def audio(tmp_path):
    """Two files of 100 frames."""
    for name in "ab":
        head = b"RIFF" + struct.pack("<I", 236) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8, 16, 2, 16)
        (tmp_path / f"{name}.wav").write_bytes(head + b"data" + struct.pack("<I", 200) + bytes(200))
    return tmp_path


def _read(folder, change=lambda: None, **options):
    r = W.WavReader({"path": str(folder), "block": "16", **options})
    planned = r.partitions()
    change()
    return sum(len(x) for p in planned for b in r.read(p) for x in b.column("samples").to_pylist())


def test_what_the_store_refuses_is_an_error(audio):
    assert _read(audio) == _read(audio, failOnRejects="true") == 200
    with pytest.raises(OSError):
        _read(audio, lambda: os.truncate(audio / "b.wav", 100))  # after its length was listed
    with pytest.raises(FileNotFoundError):
        _read(audio, lambda: os.remove(audio / "a.wav"))
    with pytest.raises(FileNotFoundError):
        _read(audio / "*.aiff")


def test_files_that_are_no_audio_can_be_errors(spark, audio):
    (audio / "bad.wav").write_bytes(b"RIFFnothing")
    assert _read(audio) == 200
    with pytest.raises(ValueError, match="bad.wav"):
        _read(audio, failOnRejects="true")
    with pytest.raises(Exception, match="bad.wav"):
        W.wav_blocks(spark, str(audio), 16, fail_on_rejects=True).collect()
    os.remove(audio / "bad.wav")
    os.truncate(audio / "b.wav", 100)
    assert _read(audio) == 128
    with pytest.raises(ValueError, match="b.wav"):
        _read(audio, failOnRejects="true")


def test_the_query_does_not_leave_files_out(spark, tmp_path):
    from lowtide.plans.audio_queries import audio_folder

    folder = _events(tmp_path, [(i, i * 4000, 1, 60.0) for i in range(130)])
    assert QUERIES["read_wav_source"](spark, folder).count() == 64
    with open(f"{audio_folder(spark, folder).removeprefix('file:')}/s00001_1.wav", "wb") as f:
        f.write(b"RIFFnothing")
    with pytest.raises(Exception, match="s00001_1.wav"):
        QUERIES["read_wav_source"](spark, folder).count()
