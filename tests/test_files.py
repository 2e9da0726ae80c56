"""Readers, writers and streams on files made in a temporary folder."""

import gzip
import json
import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.operators import catalogue as G
from lowtide.operators import samples as S
from lowtide.plans import pipelines
from lowtide.sinks import exports as K
from lowtide.sources import documents as D
from lowtide.sources import files as L
from lowtide.sources import text as X
from lowtide.sources import wav as W
from lowtide.streaming import ingest as I
from lowtide.streaming import meter as V


def write_wav(path, x, fs, width):
    scale = 2 ** (8 * width - 1) - 1
    ints = np.round(np.asarray(x) * scale).astype(np.int64)
    raw = ints.astype("<i2").tobytes() if width == 2 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in ints.ravel())
    with wave.open(str(path), "wb") as f:
        f.setnchannels(ints.shape[1] if ints.ndim > 1 else 1)
        f.setsampwidth(width)
        f.setframerate(fs)
        f.writeframes(raw)


@pytest.fixture(scope="module")
def wavs(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    t = np.arange(10000) / 4000
    x = np.stack([0.5 * np.sin(2 * np.pi * (20 + 5 * c) * t) for c in range(6)], axis=1)
    write_wav(d / "six.wav", x, 4000, 3)
    write_wav(d / "two.wav", x[:, :2], 4000, 2)
    write_wav(d / "mono one.wav", x[:, 0], 2000, 2)
    return d, x


def test_read_wav(spark, wavs):
    d, x = wavs
    got = W.read_wav(spark, f"{d}/*.wav", block=700)
    six = S.from_blocks(got.where(F.col("path").contains("six")), ["channel_no"]).toPandas()
    for c in range(6):
        y = six[six.channel_no == c].sort_values("i")["v"].to_numpy()
        assert len(y) == 10000 and np.allclose(y, x[:, c], atol=1e-6)
    assert got.where("n = 10000").count() == got.count()


def test_read_wav_range(spark, wavs):
    d, x = wavs
    part = W.read_wav(spark, f"{d}/two.wav", start_ms=101, end_ms=1300, block=256)
    y = S.from_blocks(part.where("channel_no = 1"), ["path"]).toPandas().sort_values("i")["v"].to_numpy()
    assert len(y) == 5200 - 404 and np.allclose(y, x[404:5200, 1], atol=1e-4)


def test_load_signals(spark, wavs):
    d, _ = wavs
    named, composite = W.load_signals(spark, f"{d}/*.wav")
    assert {r.name for r in named.select("name").distinct().collect()} == {
        "mono one", "two_FL", "two_FR", "six_FL", "six_FR", "six_FC", "six_LFE", "six_SL", "six_SR"
    }
    assert sorted(r.channel_count for r in composite.collect()) == [2, 6]


def test_load_channel(spark, wavs):
    d, x = wavs
    out = W.load_channel(spark, f"{d}/*.wav", channel=1, target_fs=1000, offset_db=-6.0)
    assert {r.fs for r in out.select("fs").distinct().collect()} == {1000}
    y = S.from_blocks(out.where(F.col("path").contains("six")), ["path"]).toPandas().sort_values("i")["v"].to_numpy()
    assert len(y) == 2500
    assert np.allclose(y[200:-200], (x[::4, 0] * 10 ** (-6 / 20))[200:-200], atol=1e-4)


def riff(x, fs, before=b"", magic=b"RIFF", size=None):
    """16-bit mono with chunks put before the samples."""
    raw = np.round(np.asarray(x) * 32767).astype("<i2").tobytes()
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, fs, fs * 2, 2, 16)
    body = b"WAVE" + before + fmt + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw
    return magic + struct.pack("<I", min(len(body), 0xFFFFFFFF)) + body


def test_bad_files_are_rejected_and_others_read(spark, tmp_path):
    x = np.sin(np.arange(500) / 9) / 2
    (tmp_path / "bad.wav").write_bytes(b"no audio here" * 10)
    (tmp_path / "short.wav").write_bytes(riff(x, 1000)[:30])
    (tmp_path / "good.wav").write_bytes(riff(x, 1000))
    got = S.from_blocks(W.read_wav(spark, f"{tmp_path}/*.wav"), ["path"]).toPandas().sort_values("i")
    assert len(got) == 500 and np.allclose(got["v"], x, atol=1e-4)
    errors = {os.path.basename(r.path): r.error for r in W.rejected_wav(spark, f"{tmp_path}/*.wav").collect()}
    assert set(errors) == {"bad.wav", "short.wav"} and "RIFF" in errors["bad.wav"]


def test_late_samples_and_long_files(spark, tmp_path):
    x = np.sin(np.arange(700) / 7) / 2
    (tmp_path / "late.wav").write_bytes(riff(x, 1000, b"LIST" + struct.pack("<I", 70_001) + bytes(70_002)))
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, 0, 1400, 700, 0)
    (tmp_path / "long.wav").write_bytes(riff(x, 1000, ds64, b"RF64", 0xFFFFFFFF) + b"tail" * 9)
    for name in ("late", "long"):
        got = S.from_blocks(W.read_wav(spark, f"{tmp_path}/{name}.wav"), ["path"]).toPandas().sort_values("i")
        assert len(got) == 700 and np.allclose(got["v"], x, atol=1e-4)


def test_many_rates_in_one_pass(spark):
    from lowtide.operators.resample import resample_all

    rows = [(f"s{fs}", fs, 400, 0, [1.0] * 400) for fs in range(1000, 1070)]
    blocks = spark.createDataFrame(rows, "k string, fs int, n long, start_i long, samples array<double>")
    out = resample_all(blocks, ["k"], 1000, block=128)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = S.from_blocks(out, ["k"]).toPandas()
    sizes = got.groupby("k").size()
    assert all(sizes[f"s{fs}"] == -(-400 * 1000 // fs) for fs in range(1000, 1070))
    middle = got[(got["i"] > 150) & (got["i"] < 230)]
    assert np.allclose(middle["v"], 1.0, atol=1e-3)


def test_store_names():
    from unittest import mock

    seen = []
    with mock.patch.object(L, "arrow_fs") as fs:
        fs.FileSystem.from_uri.side_effect = lambda uri: seen.append(uri) or (None, uri)
        for path in ("s3a://b/x y", "s3n://b/k", "s3://b/k", "hdfs:/d/f", "hdfs://h/d/f"):
            L.store(path)
    assert seen == ["s3://b/x%20y", "s3://b/k", "s3://b/k", "hdfs:///d/f", "hdfs://h/d/f"]


def test_scratch_folder_needs_a_local_master():
    from unittest import mock

    from lowtide.session import shared_dir

    far = mock.Mock()
    far.conf.get.return_value = None
    far.sparkContext.getCheckpointDir.return_value = None
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        far.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(far)


def test_plain_numbers(spark):
    from lowtide.functions import text as N

    values = [2.6771234567890123e-08, 1.25e-22, 1e18, -3.5e21, 0.0, -0.0, 1.0, 123.456, 1e7, 12345678.9, -0.001, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(N.plain(F.col("v")).alias("t")).collect()]
    assert [float(t) for t in got] == values and not any("e" in t.lower() for t in got)
    assert got[:4] == ["0.000000026771234567890123", "0.000000000000000000000125", "1000000000000000000.0", "-3500000000000000000000.0"]
    assert got[4:7] == ["0.0", "0.0", "1.0"]


def test_find_files(spark, wavs):
    d, _ = wavs
    assert L.find_files(spark, f"{d}/t*.wav; {d}/six.wav;{d}/six.wav").count() == 2
    assert L.find_files(spark, str(d)).count() == 3


def test_response_files(spark, tmp_path):
    (tmp_path / "film_avg.frd").write_text("* made up\n* second\n10.0 -1.5\n 20.0\t-2.5\n")
    (tmp_path / "film_filter_peak.frd").write_text("10 1\n20 2\n30 3\n")
    (tmp_path / "other_peak.frd").write_text("# x\r\n5 0\r\n250.4 0 # tail\r\n")
    got = X.read_response(spark, str(tmp_path))
    assert {(r.name, r.kind, r.f, r.db) for r in got.where("name = 'film'").collect()} == {
        ("film", "avg", 10.0, -1.5), ("film", "avg", 20.0, -2.5), ("film", "peak-filtered", 10.0, 1.0), ("film", "peak-filtered", 20.0, 2.0),
        ("film", "peak-filtered", 30.0, 3.0),
    }
    assert {(r.name, r.fs) for r in X.response_rates(got).collect()} == {("film", 60), ("other", 500)}


def test_response_round_trip(spark, tmp_path):
    curve = spark.createDataFrame([(s, k, float(f), f * 0.5 - 3) for s in ("a", "b") for k in ("avg", "peak") for f in range(1, 20)], "signal_id string, kind string, f double, db double")
    lines = K.response_lines(curve, spark.createDataFrame([("a", 100), ("b", 100)], "signal_id string, fs int"))
    K.write_responses(lines, f"{tmp_path}/out")
    assert sorted(f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")) == ["a_avg.frd", "a_peak.frd", "b_avg.frd", "b_peak.frd"]
    rows = open(f"{tmp_path}/out/a_avg.frd").read().splitlines()
    assert len(rows) == 22 and rows[0].startswith("# Signal Name: a") and rows[3] == "   1.000   -2.500"
    got = X.read_response(spark, f"{tmp_path}/out")
    assert sorted((r.name, r.kind, r.f, r.db) for r in got.collect()) == sorted((r.signal_id, r.kind, r.f, r.db) for r in curve.collect())


def test_equaliser_text(spark):
    lines = spark.createDataFrame([("ON PK Fc 100 Hz Gain 4.3 dB Q 0.707",), ("Filter 2: ON LSC Fc 20 Hz Gain -2 dB Q 0.5",), ("ON AP Fc 30 Hz Q 0.9",), ("Preamp -4.5",), ("OFF PK Fc 1 Hz",), ("",)], "line string")
    got = {(r.kind, r.freq, r.gain, r.q) for r in X.parse_equaliser(lines).collect()}
    assert got == {("PeakingEQ", 100.0, 4.3, 0.707), ("LowShelf", 20.0, -2.0, 0.5), ("AllPass", 30.0, None, 0.9), ("Gain", None, -4.5, None)}


def test_projects(spark, tmp_path):
    curve = lambda n, x: {"_type": "MagnitudeData", "name": n, "description": "avg", "x": x, "y": [1.0, 2.0, 3.0], "colour": None, "linestyle": "-"}
    channel = lambda n, **kw: {"_type": "SingleChannelSignalData", "name": n, "fs": 1000, "offset": "-1.5", "data": {"avg": curve(n, [1, 2, 3]), "peak": curve(n, {"min": 0, "max": 10, "count": 3})},
                               "filter": {"_type": "CompleteFilter", "description": "c", "fs": 1000, "filters": [{"_type": "PeakingEQ", "fs": 1000, "fc": 20.0, "q": 1.0, "gain": 2.0}]}, **kw}
    project = [
        {"_type": "BassManagedSignalData", "name": "bm", "channels": [channel("m_FL", slave_names=["m_FR", "gone"]), channel("m_FR", master_name="m_FL")],
         "bm": {"lpf_fs": 80, "lpf_position": "Before", "headroom_type": "WCS"}, "clip": {"before": True, "after": False}, "offset": "0"},
        channel("solo", duration_hhmmss="1:02:05.5", start_seconds=3.5),
    ]
    (tmp_path / "p.bin").write_bytes(gzip.compress(json.dumps(project).encode()))
    (tmp_path / "s.signal").write_bytes(gzip.compress(json.dumps(channel("single")).encode()))
    signals = D.project_signals(D.read_projects(spark, str(tmp_path)))
    rows = {r.name: r for r in signals.collect()}
    assert set(rows) == {"m_FL", "m_FR", "solo", "single"}
    assert rows["m_FL"].group_name == "bm" and rows["m_FL"].bm.lpf_position == "Before" and rows["m_FL"].clip.before is True
    assert rows["solo"].duration_s == 3725.5 and rows["solo"].start_s == 3.5 and rows["solo"].offset_db == -1.5
    points = D.curve_points(signals)
    assert {(r.f, r.db) for r in points.where("name = 'solo' and kind = 'peak'").collect()} == {(0.0, 1.0), (5.0, 2.0), (10.0, 3.0)}
    assert {(r.master, r.slave) for r in D.project_links(signals).collect()} == {("m_FL", "m_FR")}
    parts = D.filter_rows(signals.select("name", F.to_json("filter").alias("content")))
    assert parts.where("kind = 'PeakingEQ' and gain = 2.0").count() == 4


def test_catalogue_file(spark, tmp_path):
    docs = [
        {"title": "The Film", "year": 2001, "audioTypes": ["Atmos"], "author": "x", "filters": [{"type": "LowShelf", "freq": 20, "gain": 3, "q": 0.7}], "mv": "-1.5", "runtime": "oops"},
        {"title": "Show", "year": "n/a", "content_type": "TV", "season": "2", "episode": "1,2,3,5,7,8"},
    ]
    (tmp_path / "db.json").write_text(json.dumps(docs, indent=1))
    df = D.read_catalogue(spark, f"{tmp_path}/db.json")
    rows = {r.idx: r for r in df.collect()}
    assert (rows["0"].year, rows["0"].mv_adjust, rows["0"].runtime, rows["0"].content_type) == (2001, -1.5, 0, "film")
    assert (rows["1"].year, rows["1"].audio_types, rows["1"].filters) == (0, [], [])
    title = G.formatted_title(F.col("title"), F.col("content_type"), F.col("season"), F.col("episode"))
    assert [r.t for r in df.orderBy("idx").select(title.alias("t")).collect()] == ["The Film", "Show S2E1-3, 5, 7-8"]
    assert G.expand_filters(df).count() == 1


def test_duplicate_paths(spark):
    base = dict(author="a", formatted_title="T", edition="", year=2000, audio_types=["X"], content_type="film", source="Disc", mv_adjust=0.0, note="", language="")
    rows = [dict(base, idx=str(i)) for i in range(3)] + [dict(base, idx="7", formatted_title="U/v.1", source="Disc"), dict(base, idx="8", formatted_title="U/v.1", source="Streaming")]
    got = {r.idx: r for r in G.output_paths(spark.createDataFrame(rows), ".xml").collect()}
    assert got["1"].path == "film/a/T/T_2000_X_1.xml" and got["1"].problem == "Duplicate entry"
    assert got["8"].path == "film/a/U/U_v1_2000_X_Streaming.xml" and got["8"].problem is None


def test_device_settings(spark):
    item = lambda ch, slot, kind, boost, bypass=0: f'<filter name="PEQ_{ch}_{slot}" addr="1"><freq>20</freq><q>1</q><boost>{boost}</boost><type>{kind}</type><bypass>{bypass}</bypass><dec>1,2</dec></filter>'
    doc = lambda *xs: '<setting version="1"><item name="x"><dec>1</dec></item>' + "".join(xs) + '<filter name="BPF_1_1"><freq>1</freq></filter></setting>'
    files = spark.createDataFrame([
        ("same", doc(item(1, 1, "SL", 5), item(1, 2, "SL", 5), item(1, 3, "PK", 2), item(1, 4, "PK", 0), item(2, 1, "SL", 5), item(2, 2, "SL", 5), item(2, 3, "PK", 2), item(2, 5, "PK", 9, 1))),
        ("differ", doc(item(1, 1, "SL", 5), item(2, 1, "SL", 4))),
        ("three", doc(item(3, 1, "PK", 5))),
        ("many", doc(item(3, 1, "PK", 5), item(4, 1, "PK", 5))),
    ], "path string, content string")
    found, bad = D.device_filters(files)
    assert sorted((r.path, r.kind, r.gain, r.n) for r in found.collect()) == [("same", "LowShelf", 5.0, 2), ("same", "PeakingEQ", 2.0, 1), ("three", "PeakingEQ", 5.0, 1)]
    assert {(r.path, r.status) for r in bad.collect()} == {("differ", "inputs differ"), ("many", "several channels")}


def test_optimiser_export(spark):
    doc = {"mso_filters": [
        {"_type": "Delay", "chans": ["SW", "L"], "delay_val": 1.25}, {"_type": "Gain", "chans": ["SW"], "gain_val": -3.5},
        {"_type": "ComplexLowPass", "chans": ["SW"], "filter_type": "LR", "order": 4, "fc": 80}, {"_type": "PolarityInversion", "chans": ["SW"]},
        {"_type": "LinkwitzTransform", "chans": ["SW"], "f0": 50, "q0": 1, "fp": 35, "qp": 0.7}, {"_type": "Nope", "chans": ["SW"]},
    ]}
    rows = D.optimiser_rows(spark.createDataFrame([("a", json.dumps(doc))], "path string, content string"))
    got = {r.seq: r for r in rows.collect()}
    assert (got[0].kind, got[0].delay) == ("Delay", "1.25") and (got[1].kind, got[1].gain) == ("Gain", "-3.5")
    assert (got[2].family, got[2].order, got[2].frequency) == ("LR", 4, "80") and got[5].kind is None
    assert D.per_channel(rows).count() == 7


def test_probe(spark):
    audio = {"index": 1, "codec_type": "audio", "codec_name": "ac3", "codec_long_name": "AC-3", "sample_rate": "48000", "channels": 6}
    docs = [("tag", {"streams": [dict(audio, tags={"DURATION": "00:01:02.123456789"})]}), ("none", {"streams": [audio]}), ("stream", {"streams": [dict(audio, duration="10.25")], "format": {}})]
    files = spark.createDataFrame([(p, json.dumps(d)) for p, d in docs], "path string, content string")
    got = {r.path: r for r in D.probe_streams(files).collect()}
    assert got["tag"].text == "1: AC-3 - 48000Hz 6 channels  - 00:01:02.123456789" and got["tag"].duration_us == 62123456
    assert got["none"].text == "1: AC-3 - 48000Hz 6 channels " and got["none"].duration_us == 3600 * 1000000
    assert got["stream"].duration_us == 10250000


def test_late_samples_are_dropped(spark, tmp_path):
    schema = "signal_id string, ts timestamp, v double"
    rows = lambda *xs: spark.createDataFrame([("a", t, v) for t, v in xs], "signal_id string, t double, v double").select("signal_id", F.timestamp_seconds("t").alias("ts"), "v")
    run = lambda: V.run_to_table(V.live_levels(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 second", "2 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows((0.1, 0.5), (0.9, -0.5), (10.0, 0.1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows((0.5, 1.0), (20.0, 0.1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = {r.start.second: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {0, 10} and got[0].n == 2
    assert got[0].rms_db == pytest.approx(20 * np.log10(0.5))


def test_meter_equals_windowed_levels(spark):
    from lowtide.operators.stats import windowed_peaks

    fs, n = 64, 500
    df = spark.range(n).select(F.lit("a").alias("signal_id"), F.col("id").alias("i"), F.sin(F.col("id") * 0.3).alias("v"), F.lit(fs).alias("fs"))
    timed = df.withColumn("ts", F.timestamp_micros((F.col("i") * 1000000 / fs).cast("long")))
    live = V.window_levels(timed, "1 second").where(f"n = {fs}").agg(F.max("rms_db")).first()[0]
    whole = df.where(f"i < {n // fs * fs}")
    assert windowed_peaks(whole, ["signal_id"], {"slow": 1.0}).first().db == pytest.approx(live)


def test_ingest_is_repeatable(spark, tmp_path):
    schema = "digest string, title string, updated_at bigint"
    put = lambda *xs: spark.createDataFrame(list(xs), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run = lambda: I.ingest(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/cp")
    put(("a", "one", 10), ("b", "one", 10))
    run()
    put(("a", "two", 20), ("b", "old", 5), ("c", "new", 1))
    run()
    run()
    got = {r.digest: r.title for r in I.current(spark, f"{tmp_path}/t", schema).collect()}
    assert got == {"a": "two", "b": "one", "c": "new"}
    I.compact(spark, f"{tmp_path}/t", f"{tmp_path}/small", schema)
    assert {r.digest: r.title for r in I.current(spark, f"{tmp_path}/small", schema).collect()} == got


def test_audio_to_filtered_curve(spark, wavs):
    d, _ = wavs
    response = spark.createDataFrame([(float(f), 3.0) for f in range(0, 500, 5)], "f double, db double")
    out = pipelines.filtered_spectrum(spark, f"{d}/six.wav", response, target_fs=1000)
    assert out.select("channel_no").distinct().count() == 6
    assert out.where("abs(filtered_db - db - 3.0) > 1e-6").count() == 0


def test_exported_names_groups_and_all_kinds_come_back(spark):
    """Quotes and backslashes in names, a bass-managed group, Linkwitz and compound filters, through writer and reader."""
    name = 'a "quoted" \\ name\n2'
    sets = spark.createDataFrame(
        [
            ("s", 0, "LinkwitzTransform", 1000, None, None, None, 1, 20.0, 0.7, 15.0, 0.5, None, None),
            ("s", 1, "ComplexLowPass", 1000, 80.0, 0.7, None, 1, None, None, None, None, "LR", 4),
            ("s", 2, "ComplexHighPass", 1000, 20.5, 0.7, None, 1, None, None, None, None, "BW", 2),
            ("s", 3, "LowShelf", 1000, 30.0, 0.8, 4.5, 2, None, None, None, None, None, None),
        ],
        "filter_set_id string, seq int, kind string, fs int, freq double, q double, gain double, n int, f0 double, q0 double, fp double, qp double, family string, order int",
    )
    docs = K.filter_set_json(sets, description=name)
    assert json.loads(docs.first().content)["description"] == name
    back = [tuple(r) for r in D.filter_rows(docs).orderBy("seq").select("kind", "freq", "family", "order", "f0", "q0", "fp", "qp", "n").collect()]
    assert back == [
        ("LinkwitzTransform", None, None, None, 20.0, 0.7, 15.0, 0.5, 1), ("ComplexLowPass", 80.0, "LR", 4, None, None, None, None, 1),
        ("ComplexHighPass", 20.5, "BW", 2, None, None, None, None, 1), ("LowShelf", 30.0, None, None, None, None, None, None, 2),
    ]
    curves = spark.createDataFrame([(n, k, 10.0 * j, -j * 1.0) for n in (name, "plain") for k in ("avg", "peak") for j in range(1, 4)], "signal_id string, kind string, f double, db double")
    signals = spark.createDataFrame([(name, 1000, 1.5, None, None, ["plain"], "12.5"), ("plain", 1000, 0.0, None, name, [], None)], "signal_id string, fs int, offset_db double, filter_json string, master_name string, slave_names array<string>, duration_seconds string")
    channels = K.signal_json(signals, curves).select(F.lit(1).alias("group_id"), F.when(F.col("signal_id") == "plain", 1).otherwise(0).alias("seq"), "content")
    group = spark.createDataFrame([(1, name, 80.0, "Before", "WCS", True, False, 2.0)], "group_id int, name string, lpf_fs double, lpf_position string, headroom_type string, clip_before boolean, clip_after boolean, offset_db double")
    files = K.group_json(group, channels).select(F.col("group_id").cast("string").alias("path"), "content")
    got = {r.name: r for r in D.project_signals(files).collect()}
    assert set(got) == {name, "plain"}
    for r in got.values():
        assert r.group_name == name and tuple(r.bm) == (80.0, "Before", "WCS") and tuple(r.clip) == (True, False)
    assert got[name].slave_names == ["plain"] and got[name].duration_s == 12.5 and got["plain"].master_name == name


def test_equal_times_in_a_batch_do_not_depend_on_arrival(spark):
    rows = [("d", 5, "x", 0), ("d", 5, "y", 0), ("d", 5, "z", 0)]
    schema = "digest string, updated_at long, title string, batch long"
    winners = {I.newest(spark.createDataFrame(rows[k:] + rows[:k], schema).coalesce(1)).first().title for k in range(3)}
    assert len(winners) == 1
