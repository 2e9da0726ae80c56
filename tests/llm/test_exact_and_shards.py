"""Sharding, exact copies, mixing and packing against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lowtide.llm import chunk_dedup, mixing, packing, sharding
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def _cost(key, shard, weight):
    draw = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)
    return -math.log(draw) / weight


def test_sharding_is_the_least_cost(spark):
    rows = QUERIES["op5_sharding"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        costs = [_cost(r.doc_id, s, 1.0) for s in range(25)]
        assert r.shard == costs[:24].index(min(costs[:24])) and r.grown_shard == costs.index(min(costs))
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_and_growth(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("old"))
    rows = sharding.assign(df, weights=(1.0, 3.0), added=2.0).collect()
    share = Counter(r.shard for r in rows)
    assert 0.70 < share[1] / len(rows) < 0.80
    assert all(r.grown_shard in (r.shard, 2) for r in rows)
    assert 0.28 < sum(r.grown_shard == 2 for r in rows) / len(rows) < 0.39


def test_sharding_odd_rows(make, odd_rows):
    rows = sharding.with_slots(sharding.assign(make(odd_rows)), ["doc_id"]).collect()
    assert len(rows) == len(odd_rows) and all(r.grown_shard is None for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.with_slots(sharding.assign(make([])), ["doc_id"]).count() == 0


def _brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_copies(make, odd_rows, prose, bits):
    """With 2 bits almost every chunk hash collides, and the bytes decide."""
    base = prose(900, 5)
    rows = odd_rows + [(20, base), (21, base.upper()), (22, base + "x"), (23, base[:3000] + "y" + base[3001:]), (24, prose(900, 6)), (25, "É"), (26, "é")]
    docs = make(rows).withColumn("chunk", F.lit(1)).withColumn("key", F.lit(2))
    got = chunk_dedup.deduplicate(docs, mean=256, most=1024, bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_copies(rows)
    assert chunk_dedup.deduplicate(make([]), bits=bits).count() == 0


def test_cuts_move_with_the_content(prose):
    text = prose(6000, 7).encode()
    cuts = {text[max(0, c - 40) : c] for c in chunk_dedup.cut_points(text, 256, 4096)}
    moved = {(b"new start " + text)[max(0, c - 40) : c] for c in chunk_dedup.cut_points(b"new start " + text, 256, 4096)}
    assert len(cuts & moved) > 0.9 * len(cuts)
    ends = chunk_dedup.cut_points(b"a" * 10_000, 256, 1000)
    assert ends[-1] == 10_000 and max(np.diff([0, *ends])) <= 1000
    assert chunk_dedup.cut_points(b"", 256, 1000) == [0]


def _targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mixing_meets_its_targets(spark):
    rows = QUERIES["op2_mixing"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(docs[r.doc_id].text.encode().split()) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx(_targets(sizes))
    least = min(r.size for r in rows if r.size)
    assert all(abs(taken[s] - target[s]) <= max(least, 0.02 * target[s]) for s in sizes)
    again = QUERIES["op2_mixing"](spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_odd_rows(make, odd_rows):
    docs = make(odd_rows).withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long"))
    rows = mixing.mix(docs, "size").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    assert len(rows) == len(odd_rows)
    assert all(r.target == pytest.approx(_targets(sizes)[r.source]) and r.copies <= 3 for r in rows)
    assert mixing.mix(make([]).withColumn("size", F.lit(1).cast("long")), "size").count() == 0
    mixed = mixing.mixed_documents(make(odd_rows))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert max(Counter(r.doc_id for r in mixed.collect() if r.doc_id not in (4, None)).values()) <= 3
    assert mixing.mixed_documents(make([])).count() == 0


def test_budget_fit():
    rng = np.random.default_rng(3)
    for trial in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 60), 6, replace=False))
        counts = np.ones(6, np.int64) if trial % 2 else rng.integers(1, 5, 6)
        budget = int(rng.integers(0, (lengths * counts).sum()))
        for width in (0, 1 << 16):
            n = mixing.fit(lengths, counts, budget, width)
            assert (0 <= n).all() and (n <= counts).all() and abs((n * lengths).sum() - budget) <= 60
        if trial % 2:  # nothing is taken in proportion, so the knapsack alone decides, and it is exact
            sums = {0}
            for length in lengths.tolist():
                sums |= {s + length for s in sums}
            assert abs((n * lengths).sum() - budget) == min(abs(s - budget) for s in sums)


def test_packing_round_trip(spark, make, odd_rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = [(i, r[1]) for i, r in enumerate(odd_rows)] + [
        (100, "İstanbul ΑΣ don't WE'RE 'sx x's 12ab²¼ naïve\xa0x a\x85b é ẞ ß日本 'llama ªº ŉ ĿL ſ \xadx ''d ǅ é"),
        (101, "a" * 5000),
        (102, "it's " * 4095),
    ]
    texts = {i: t or "" for i, t in rows}
    got = packing.packed_documents(make(rows), with_ids=True).collect()
    ids, windows = defaultdict(dict), defaultdict(list)
    for r in got:
        ids[r.doc_id][r.start] = [x & 0xFFFFFFFF for x in r.ids]
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        windows[r.sequence_id].append((r.offset, r.length))
    for i, text in texts.items():
        joined = [x for start in sorted(ids[i]) for x in ids[i][start]]
        assert joined == tokenizer.encode(text, add_special_tokens=False).ids + [2]
    for places in windows.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 4096
    assert packing.packed_documents(make([])).count() == 0


def test_packing_of_added_tokens(make):
    """Strings of added tokens in a text, apart and glued to words, by the plain call."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["foo <|endoftext|> bar", "<|startoftext|>", "a<|endoftext|>b it's<|startoftext|><|endoftext|>é", "<|ENDOFTEXT|> <|endoftext| > x<|startoftext|>\ny", "日本<|endoftext|>"]
    got = packing.packed_documents(make(list(enumerate(texts))), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: tokenizer.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    for r in got:
        assert r.doc_tokens == r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_packing_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 1.0, 1024).astype(int), 1, 4095)
    where = packing.windows_of(lengths, 4096)
    sums = np.bincount(where, weights=lengths)
    assert sums.max() <= 4096 and lengths.sum() / (4096 * len(sums)) > 0.98


def test_differencing_two_ways():
    """The textbook case: 8, 7, 6, 5, 4 differ by 2 after differencing in two."""
    where, most = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert most == 16 and np.bincount(where, weights=[8, 7, 6, 5, 4]).tolist() in ([16, 14], [14, 16])
    with_one, most = packing.difference(np.array([3, 1]), 1)
    assert most == 4 and set(with_one) == {0}
