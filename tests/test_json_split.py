"""Elements of JSON arrays in ranges of any size, and of gzip streams with bounded memory."""

import gzip
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lowtide.sources import documents as D
from lowtide.sources import json_split as J

leaf = st.one_of(st.none(), st.booleans(), st.integers(), st.text(alphabet='ab"\\[]{},: é\n', max_size=12))
value = st.recursive(leaf, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(alphabet='k"\\[', max_size=3), inner, max_size=3)), max_leaves=12)


def _by_ranges(data, size):
    """As the two passes have it, in plain Python."""
    read = lambda at, n: data[at : at + n]
    parts = []
    for first in range(0, len(data), size):
        last = min(first + size, len(data))
        told = []
        for inside in (False, True):
            _, steps, end, _ = J.marks(data[first:last], inside, J._escaped_at(read, first))
            depth = steps.cumsum()
            told.append((end, int(steps.sum()), {int(d): int((depth[steps == 0] == d).sum()) for d in set(depth.tolist())}, bool(len(steps))))
        parts.append({"path": "x", "part": first // size, "first": first, "last": last, "ends": [t[0] for t in told], "depth": [t[1] for t in told], "commas": [list(t[2].items()) for t in told], "some": [t[3] for t in told]})
    import pandas as pd

    out = []
    for r in J._composed(pd.DataFrame(parts)).itertuples(index=False):
        cutter = J.ElementCutter(r.first, r.last, r.inside, J._escaped_at(read, r.first), r.depth)
        at = r.at
        for lo in range(r.first, len(data), 3):
            for e in cutter.feed(data[lo : lo + 3]):
                out.append((at, json.loads(e)))
                at += 1
            if cutter.done:
                break
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(value, max_size=6), st.sampled_from([None, 1, "\t"]), st.booleans(), st.integers(1, 40))
def test_ranges_of_any_size(values, indent, ascii_only, size):
    data = (" \n" + json.dumps(values, indent=indent, ensure_ascii=ascii_only) + "\n").encode()
    assert sorted(_by_ranges(data, size), key=lambda x: x[0]) == list(enumerate(values))
    assert [json.loads(e) for e in J.elements(data[i : i + size] for i in range(0, len(data), size))] == values


def test_one_array_in_64_ranges_is_the_serial_parse(spark, tmp_path):
    r = random.Random(4)
    entry = lambda k: {
        "title": f'T{k} "[{{,}}]" \\" \\\\', "year": str(1950 + k % 70), "audioTypes": ["a,b", "c]"], "mv": "1.5", "overview": "\\" * (k % 9) + '"é]' * r.randint(0, 9),
        "filters": [{"type": "LowShelf", "freq": 20.0 + k, "gain": 1.0, "q": 0.7}], "collection": {"id": "1", "name": "n["},
    }
    text = json.dumps([entry(k) for k in range(500)], indent=1)
    path = tmp_path / "all.json"
    path.write_text(text)
    size = -(-len(text.encode()) // 64)
    split = J.json_elements(spark, str(path), size)
    assert split.count() == 500 and max(len(x.content) for x in split.collect()) < len(text) // 50
    serial = D.parse_catalogue(spark.createDataFrame([(text,)], "content string"))
    assert sorted(map(repr, D.read_catalogue(spark, str(path), size).collect())) == sorted(map(repr, serial.collect()))


def test_odd_files(spark, tmp_path):
    for name, text in {"empty": "", "blank": " \n", "none": "[ ]", "object": ' {"a": [1, 2]}', "cut": '[{"a": 1}, {"a": 2}, {"a":', "long": json.dumps(["x" * 5000, "\\" * 4999, 3])}.items():
        (tmp_path / f"{name}.json").write_text(text)
    for size in (7, 1000, 1 << 20):
        got = {}
        for r in J.json_elements(spark, str(tmp_path), size).collect():
            got.setdefault(r.path.rsplit("/", 1)[1].split(".")[0], []).append((r.at, json.loads(r.content) if r.content.strip() else None))
        assert sorted(got["cut"]) == [(0, {"a": 1}), (1, {"a": 2})] and got["object"] == [(0, {"a": [1, 2]})]
        assert sorted(got["long"]) == [(0, "x" * 5000), (1, "\\" * 4999), (2, 3)]
        assert "none" not in got and "empty" not in got


def test_gzip_is_inflated_in_bounded_pieces(monkeypatch):
    """200 MB of signals out of a small gzip file: neither a piece nor what is held grows with it."""
    signal = json.dumps({"name": "s", "y": [0.125] * 4000}).encode()
    packer = gzip.zlib.compressobj(9, gzip.zlib.DEFLATED, 31)
    n = 200_000_000 // len(signal)
    blob = b"".join([packer.compress(b"[")] + [packer.compress(signal + (b"," if k < n - 1 else b"]")) for k in range(n)] + [packer.flush()])
    read = lambda at, size: blob[at : at + size]
    largest = count = 0
    pieces = []

    def watched():
        for piece in J.inflated(read):
            pieces.append(len(piece))
            yield piece

    for batch in J._batches(("p", k, e) for k, e in enumerate(J.elements(watched()))):
        largest, count = max(largest, batch.nbytes), count + batch.num_rows
    assert count == n and max(pieces) <= J.CHUNK_BYTES and largest < 2 * J.BATCH_BYTES


def test_gzip_members_and_faults(spark, tmp_path):
    (tmp_path / "two.signal").write_bytes(gzip.compress(b'[{"a": 1},') + gzip.compress(b'{"a": "]"}]') + b"\0" * 8)
    (tmp_path / "plain.signal").write_bytes(b'{"a": 3}')
    got = sorted((r.path.rsplit("/", 1)[1], r.at, r.content) for r in J.gzip_elements(spark, str(tmp_path)).collect())
    assert got == [("plain.signal", 0, '{"a": 3}'), ("two.signal", 0, '{"a": 1}'), ("two.signal", 1, '{"a": "]"}')]
    whole = gzip.compress(b'[{"a": 1}]' * 1000)
    with pytest.raises(ValueError):
        list(J.inflated(lambda at, size: whole[:-30][at : at + size]))
