"""The sink with a commit, and audio read through pushed filters."""

import gzip
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from lowtide.sinks.grouped import write_files
from lowtide.sources import wav as A
from lowtide.sources import wav_source as W


def _rows(spark, n=40):
    return spark.range(n).repartition(7).select((F.col("id") % 3).alias("k"), "id", F.concat(F.lit("é line "), "id").alias("v"))


def _tree(path):
    return {f: open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if not f.startswith(".")}


def test_files_by_name_and_rerun(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        write_files(_rows(spark), path, F.concat(F.lit("a/b "), "k"), F.col("v"), ["id"], extension=".txt", head="<", between="|", tail=">")
        got = _tree(path)
        assert set(got) == {f"a%2Fb {k}.txt" for k in range(3)}
        for k in range(3):
            assert got[f"a%2Fb {k}.txt"].decode() == "<" + "|".join(f"é line {i}" for i in range(k, 40, 3)) + ">"
    write_files(_rows(spark), path, F.lit("zipped"), F.to_json(F.struct("id")), ["id"], mode="append", head="[", between=",", tail="]", extension=".gz", compression="gzip")
    got = _tree(path)
    assert len(got) == 4 and json.loads(gzip.decompress(got["zipped.gz"])) == [{"id": i} for i in range(40)]
    before = _tree(path)
    write_files(_rows(spark).where("false"), path, F.lit("x"), F.col("v"), ["id"], mode="append")
    assert _tree(path) == before


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_files(_rows(spark), path, F.col("k"), F.col("v"), ["id"])
    before = _tree(path)
    broken = F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("v"))
    with pytest.raises(Exception):
        write_files(_rows(spark), path, F.concat(F.lit("new"), "k"), broken, ["id"])
    with pytest.raises(Exception):
        write_files(_rows(spark), path, F.when(F.col("k") == 1, None).otherwise("x"), F.col("v"), ["id"])
    assert _tree(path) == before


def _wav(path, frames, channels=2, fs=8):
    x = np.arange(frames * channels).reshape(frames, channels) % 30000
    raw = x.astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, fs, fs * 2 * channels, 2 * channels, 16)
    with open(path, "wb") as f:
        f.write(head + b"data" + struct.pack("<I", len(raw)) + raw)
    return x / 32768.0


@pytest.fixture
def library(tmp_path):
    found = {f"{n}.wav": _wav(tmp_path / f"{n}.wav", frames, c) for n, frames, c in (("a", 1000, 2), ("b", 37, 1), ("c", 5000, 3), ("none", 0, 2))}
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("text")
    return tmp_path, found


def _key(r):
    return r.path.rsplit("/", 1)[1], r.channel_no, r.start_i, r.fs, r.n, r.block_no, tuple(r.samples)


@pytest.mark.parametrize("size", [100, 3000, 1 << 20])
def test_same_blocks_as_the_reader(spark, library, size):
    folder, _ = library
    got = sorted(map(_key, W.wav_blocks(spark, f"{folder}/*.wav", 16, size).collect()))
    assert got == sorted(map(_key, A.read_wav(spark, f"{folder}/*.wav", block=16).collect()))


def test_filters_reach_the_reader(spark, library):
    folder, found = library
    rows = W.wav_blocks(spark, str(folder), 16, 2000).where("start_i between 160 and 170 and channel_no = 1 and path like '%c.wav'").collect()
    assert [(r.channel_no, r.start_i) for r in rows] == [(1, 160)]
    assert rows[0].samples == pytest.approx(found["c.wav"][160:176, 1])


def test_only_wanted_bytes_are_read(library, monkeypatch):
    folder, found = library
    read = []
    monkeypatch.setattr(W, "open_range", lambda path, at, size: read.append((path, size)) or A.open_range(path, at, size))

    def run(*filters):
        read.clear()
        r = W.WavReader({"path": str(folder), "block": "16", "partitionBytes": "2000"})
        left = list(r.pushFilters(list(filters)))
        return [b for p in r.partitions() for b in r.read(p)], left

    run()
    whole = sum(size for _, size in read)
    assert whole == 2 * sum(x.size for x in found.values())
    batches, left = run(GreaterThanOrEqual(("start_i",), 160), LessThan(("start_i",), 192), EqualTo(("channel_no",), 1))
    assert {p.rsplit("/", 1)[1]: sum(s for q, s in read if q == p) for p, _ in read} == {"a.wav": 32 * 4, "c.wav": 32 * 6} and len(left) == 2
    assert sum(b.num_rows for b in batches) == 4
    run(In(("channel_no",), (2,)), StringStartsWith(("path",), f"{folder}/c"))
    assert {p.rsplit("/", 1)[1] for p, _ in read} == {"c.wav"}
    assert not run(EqualTo(("path",), "elsewhere"))[0] and not read
