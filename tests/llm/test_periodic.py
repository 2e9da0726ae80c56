"""Periodic runs against plain comparison of words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.llm import periodic
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(words, least=24, periods=3):
    """Maximal stretches with each period, by comparing the words with themselves shifted."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    out = []
    for q in range(1, len(w) // periods + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            n = b - a + q
            least_period = not any((w[a : a + n - p] == w[a + p : a + n]).all() for p in range(1, q)) if n >= max(least, periods * q) else False
            if least_period:
                out.append((a, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _kept(words, runs):
    gone = {i for start, n, q in runs for i in range(start + q, start + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_all_runs_of_short_sequences():
    r = random.Random(3)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(r.randint(0, 50))]
        if r.random() < 0.5:
            w = w[: r.randint(0, 9)] + w[: r.randint(1, 8)] * r.randint(2, 8) + w[: r.randint(0, 20)]
        assert sorted(periodic.all_runs(w), key=lambda x: (x[0], x[2])) == _brute(w, 2, 2)
        words = [str(x).encode() for x in w]
        for least, periods in ((24, 3), (6, 3), (3, 3), (10, 4)):
            assert periodic.long_runs(words, least, periods) == _brute(w, least, periods)


def test_work_stays_near_the_length():
    """Segments met by all appends: a small multiple of n for periodic, Fibonacci and random words."""
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    r = random.Random(5)
    for w in ([0] * 20_000, list(range(500)) * 40, b[:20_000], [r.randrange(2) for _ in range(20_000)]):
        seen = periodic.LastSeen()
        assert sum(len(seen.append(x)) for x in w) < 16 * len(w)


def test_odd_rows_and_clashing_columns(make, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(50, "a b c " * 9), (51, "x " * 23), (52, "x " * 24), (None, "a b " * 12 + "c"), (54, " ".join(map(str, range(30))) + " tail" * 40 + " end"), (55, "é ü\n" * 20)]
    names = ("runs", "collapsed", "start", "length", "period", "n_runs", "_1", "a b", "_approx")
    docs = make(rows).withColumns({c: F.lit(f"mine {c}") for c in names})
    got = periodic.find_runs(docs)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names}
    out = []
    for r in got.collect():
        assert all(r[c] == f"mine {c}" for c in names[2:])
        out.append((r.doc_id, r.text, [tuple(x) for x in r.runs], r.collapsed))
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = _brute(words) if len(words) < 5000 else []
        want.append((doc_id, text, runs, _kept(words, runs)))
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert periodic.find_runs(make([])).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, periods=2)


def _whole(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(_kept(words, runs)))


def test_query_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in df.dtypes if not c.endswith("sha256")} == {"bigint"}
    got = sorted(tuple(r) for r in df.collect())
    want = sorted(_whole(*d) for d in docs)
    assert got == want and sum(r[1] > 0 for r in got) > 5
