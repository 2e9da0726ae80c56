"""Periodic stretches of word sequences: all runs of a text by a suffix automaton with link-cut access."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, text_bytes

#: A reported run has at least this many words, and this many times its period.
LEAST_WORDS = 24
LEAST_PERIODS = 3
BATCH_BYTES = 4 << 20

_ROLL = np.uint64(0x9E3779B97F4A7C15)


class LastSeen:
    """A suffix automaton of a growing sequence that knows where each of its strings ended last.

    The suffix links form a tree. All strings of a node end at the same places, and appending a word makes the path from
    the new node to the root end here. Nodes of one path with the same last end form a segment, kept as a splay tree
    ordered by length; ``append`` walks the segments upwards (the access of a link-cut tree), tells the last end and the
    greatest length of each, and makes the whole path one segment. The number of segments met is logarithmic per
    word, amortised.
    """

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]
        self.up, self.short, self.long = [-1], [-1], [-1]  # splay trees; up of a splay root is the link of its shortest node
        self.last = [-1]  # of a segment, held by its splay root
        self.whole = 0
        self.size = 0

    def _node(self, length: int, link: int, following: dict) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.next, following), (self.up, -1), (self.short, -1), (self.long, -1), (self.last, -1)):
            column.append(value)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        up, short, long, last = self.up, self.short, self.long, self.last

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if g >= 0 and short[g] == p:
                short[g] = x
            elif g >= 0 and long[g] == p:
                long[g] = x
            else:
                last[x] = last[p]
            if short[p] == x:
                short[p] = b = long[x]
                long[x] = p
            else:
                long[p] = b = short[x]
                short[x] = p
            if b >= 0:
                up[b] = p
            up[p], up[x] = x, g

        while True:
            p = up[x]
            if p < 0 or (short[p] != x and long[p] != x):
                return
            g = up[p]
            if g >= 0 and (short[g] == p or long[g] == p):
                if (short[p] == x) == (short[g] == p):
                    rotate(p, g)
                else:
                    rotate(x, p)
                    p = g
            rotate(x, p)

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, greatest length) of every segment of the new word's path that ended somewhere before."""
        length, link, following = self.length, self.link, self.next
        here = self.size
        self.size += 1
        new = self._node(here + 1, 0, {})
        p = self.whole
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                part = self._node(length[p] + 1, link[q], dict(following[q]))
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = part
                    p = link[p]
                # It ended where q did, so it joins q's segment as q's next shorter node.
                self._splay(q)
                self.short[part] = self.short[q]
                if self.short[part] >= 0:
                    self.up[self.short[part]] = part
                self.short[q], self.up[part] = part, q
                link[q] = link[new] = part
        self.up[new] = link[new]
        self.whole = new

        up, long, last = self.up, self.long, self.last
        found = []
        below, x = -1, new
        while x >= 0:
            self._splay(x)
            if last[x] >= 0:
                found.append((last[x], length[x]))
            if long[x] >= 0:
                last[long[x]] = last[x]
            long[x] = below
            below, x = x, up[x]
        last[below] = here
        self._splay(new)
        return found


def all_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal repetition of at least two periods, in order of discovery.

    Where a string of a segment ended last at e, is at least i - e words long and ends at i again, its last i - e words
    stand there twice: a square. A square whose half is no repetition itself is always met so, because between its two
    halves no other occurrence of the half can end. The first square of a run is extended; the later ones lie within.
    """
    seen = LastSeen()
    reach: dict[int, int] = {}  # period: where its last run ends
    out = []
    for i, word in enumerate(words):
        for end, longest in seen.append(word):
            period = i - end
            if period > longest or reach.get(period, -1) >= i:
                continue
            start, stop = i - 2 * period + 1, i + 1
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            reach[period] = stop - 1
            out.append((start, stop - start, period))
    return out


def stretches(hashes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """(first, after the last word) of the places in which a run of that size may lie, whole.

    A run of at least ``least`` words and ``periods`` (3 or more) periods holds every string of k words that it has at
    least twice, where k is least + 1 - 2 * least / periods: its L - k + 1 places are two periods or more. So a run lies
    within neighbouring places of strings of k words that the text has again; equal strings have equal hashes.
    """
    k = max(1, least + 1 - -(-2 * least // periods))
    n = len(hashes) - k + 1
    if n < 2:
        return []
    grams = hashes[:n].copy()
    for j in range(1, k):
        grams = mixed(grams) * _ROLL + hashes[j : j + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    breaks = np.flatnonzero(np.diff(at) > k) + 1
    found = [(int(part[0]), int(part[-1]) + k) for part in np.split(at, breaks)]
    return [(a, b) for a, b in found if b - a >= least]


def long_runs(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs with at least ``least`` words and ``periods`` periods, by start and period."""
    out = []
    if len(words) >= least:
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        for a, b in stretches(hashes, least, periods):
            ids: dict[bytes, int] = {}
            part = [ids.setdefault(w, len(ids)) for w in words[a:b]]
            out += [(a + s, n, q) for s, n, q in all_runs(part) if n >= max(least, periods * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def find_runs(
    docs: DataFrame,
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """All rows with ``runs`` array<struct<start, length, period>> and ``collapsed``, the text with one period of each run.

    Words are what stands between ASCII white space, numbered from 0; a run is a stretch of them with least period q, at
    least ``least`` words and ``periods`` (3 or more) times q, that cannot be extended. ``prepare(doc_id, words)`` may
    change the words before. Every row is judged alone, so ties, repeated rows and null ids need no rule. Null and empty
    texts have no runs and an empty ``collapsed``. A very long text costs memory in proportion to its repeated parts
    alone. An empty table gives no rows. Other columns pass through, whatever they are called; ``runs`` and
    ``collapsed`` are replaced.
    """
    if periods < 3 or least < periods:
        raise ValueError("runs need three periods, and as many words, at least")
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    id_at, text_at = names.index("doc_id"), names.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: list[list[dict]] = []
            short: list[bytes] = []
            done = size = 0

            def rows(lo: int) -> pa.RecordBatch:
                columns = [c.slice(lo, len(runs)) for c in batch.columns]
                texts = pa.array(short, pa.binary()).cast(pa.string())
                return pa.RecordBatch.from_arrays([*columns, pa.array(runs, kind), texts], [*names, "runs", "collapsed"])

            for doc_id, raw in zip(batch.column(id_at).to_pylist(), text_bytes(batch.column(text_at))):
                words = raw.split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                found = long_runs(words, least, periods)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                short.append(collapsed(words, found))
                size += len(raw)
                if size > BATCH_BYTES:
                    yield rows(done)
                    done, size = done + len(runs), 0
                    runs, short = [], []
            yield rows(done)

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        run, f"{types}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query has them: by the id's hash, one text in ten repeats itself from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the strongest one, and digests of all of them and of the collapsed text."""
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=planted).drop("text")
    stronger = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: (
        F.when(stronger(a, b) != 0, F.signum(stronger(b, a)))
        .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]))
        .otherwise(F.signum(a["period"] - b["period"]))
        .cast("int")
    )
    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select("doc_id", "n_runs", "start", "length", "period", F.expr("(1000 * length) div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
