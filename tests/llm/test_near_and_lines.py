"""Near copies, lines and spans against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lowtide.llm import line_dedup, mixing, near_dedup, span_dedup
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute_components(rows):
    sets = [_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def _edited(text, every, seed):
    words = text.split(" ")
    return " ".join(w + "q" * (i % every == seed % every) for i, w in enumerate(words))


def test_near_copies_of_all_kinds(make, odd_rows, prose):
    base = prose(300, 11)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] is not None]
    rows += [(100 + k, _edited(base, 60 + k, 7 * k)) for k in range(40)] + [(200, base), (201, base.upper()), (202, "a b c d"), (203, "A B C D")]
    rows += [(300 + k, base[: 900 + 25 * k]) for k in range(30)]
    want = _brute_components(rows)
    docs = make(rows).withColumn("node", F.lit(0)).withColumn("sketch", F.lit("x"))
    for depth, node in ((4, 2048), (1, 8), (0, 6)):  # also with nodes that branch, and that end in tiles
        got = near_dedup.near_duplicates(docs, depth=depth, node=node).drop("place").collect()
        assert sorted(map(tuple, got), key=repr) == want
    kept = near_dedup.without_near_duplicates(make(rows))
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _, k in want if k}
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_near_copies_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op4_near_dedup"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == _brute_components(docs)


def test_null_ids_are_never_a_component_beside_others(make, prose):
    rows = [(None, prose(50, 1)), (3, prose(50, 1)), (None, prose(50, 2)), (None, None)]
    got = near_dedup.near_duplicates(make(rows)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(None, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=repr
    )


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").cast("string").cast("binary").alias("a"), (F.col("id") + 1).cast("string").cast("binary").alias("b"))
    got = near_dedup.components(edges).collect()
    assert len(got) == 60 and {bytes(r.root) for r in got} == {b"0"}


def _own_cuts(lines):
    """Where chunks begin, told anew: after each line whose rolling hash is least among its neighbours."""
    m64 = (1 << 64) - 1

    def scramble(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & m64
        return x ^ (x >> 33)

    h = [xxhash.xxh3_128_intdigest(x.encode()) & m64 for x in lines]
    r = [scramble((h[i] + (h[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) & m64) for i in range(len(h))]
    out, equal = [0] if lines else [], 0
    for i in range(1, len(r) - 1):
        equal = equal + 1 if r[i - 1] == r[i] == r[i + 1] else 0
        if r[i - 1] > r[i] <= r[i + 1] or (equal > 0 and equal % 2 == 0):
            out.append(i + 1)
    return out


def _brute_lines(rows):
    """Chunks and seams compared as plain lists of lines, each with its first place, and settled line by line."""
    places = []  # (row, rank, lines, their numbers, looked-up ranges with their surroundings)
    for n, (doc_id, text) in enumerate(rows):
        numbered = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((text or "").split("\n"))]
        numbered = [(i, x) for i, x in numbered if x]
        lines = [x for _, x in numbered]
        rank = (-1, _text_hash(text)) if doc_id is None else (doc_id, 0)
        ranges = []
        if len(lines) > 1:
            at = [*_own_cuts(lines), len(lines)]
            for k in range(len(at) - 1):
                low, high = max(0, at[max(0, k - 1)] - 2), min(len(lines), at[min(len(at) - 1, k + 2)] + 2)
                if at[k + 1] - at[k] > 1:
                    ranges.append((at[k], at[k + 1], low, high))
                if k:
                    ranges.append((at[k] - 1, at[k] + 1, low, min(len(lines), at[k + 1] + 2)))
        places.append((n, rank, lines, [i for i, _ in numbered], sorted(ranges)))
    first = {}
    for n, rank, lines, _, ranges in places:
        for a, b, low, high in ranges:
            key = tuple(lines[a:b])
            here = (rank, _text_hash(rows[n][1]), a)
            if key not in first or here < first[key][0]:
                first[key] = (here, lines[low:a], lines[b:high])
    out = []
    for n, rank, lines, numbers, ranges in places:
        gone, seen = set(), {}
        for a, b, low, high in ranges:
            (there, *_), before, behind = first[tuple(lines[a:b])]
            if rank > there:
                x, y = a, b
                while x > low and a - x < len(before) and lines[x - 1] == before[len(before) - (a - x) - 1]:
                    x -= 1
                while y < high and y - b < len(behind) and lines[y] == behind[y - b]:
                    y += 1
                gone.update(range(numbers[x], numbers[y - 1] + 1))
            gap = a - seen.setdefault(tuple(lines[a:b]), a)
            if gap >= b - a:
                x, y = a, b
                while x - gap > 0 and y - x < gap and lines[x - 1] == lines[x - 1 - gap]:
                    x -= 1
                while y < len(lines) and y - x < gap and lines[y] == lines[y - gap]:
                    y += 1
                gone.update(range(numbers[x], numbers[y - 1] + 1))
        doc_id, text = rows[n]
        left = [x for i, x in enumerate((text or "").split("\n")) if i not in gone]
        out.append((doc_id, "\n".join(left) if gone else text, len(gone)))
    return sorted(out, key=repr)


_HASHES = {}


def _text_hash(text):
    """The library's hash of a text, which orders rows without id."""
    return _HASHES[text]


def learn_hashes(spark, rows):
    for r in spark.createDataFrame([(t,) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect():
        _HASHES[r.text] = r.h


@pytest.fixture
def hashes(spark):
    return lambda rows: learn_hashes(spark, rows)


@pytest.mark.parametrize("bits", [128, 9])
def test_line_chunks(make, odd_rows, prose, bits, hashes):
    block = "".join(f"shared line {i} of a passage\n" for i in range(12))
    lines = [f"own line {i}" for i in range(40)]
    rows = [(r[0], r[1]) for r in odd_rows if bits == 128 or len(r[1] or "") < 500]
    rows += [
        (30, "\n".join(lines[:20]) + "\n" + block + "\n".join(lines[20:])),
        (31, block + "tail\n\n  " + block.replace("\n", "  \n")),
        (32, "head\n" + block + "end"),
        (33, block),
        (34, "one line"),
        (35, "one line"),
        (36, "same\n" * 30 + "other\n" + "same\n" * 17),
        (37, "same\n" * 50),
    ]
    if bits < 128:
        rows = rows[-7:]
    hashes(rows)
    names = ("first", "_at", "_lines", "_doc", "_place", "_spans", "_left", "_rest", "none", "run", "a b", "a.b", "lines")
    docs = make(rows).withColumns({"removed_lines": F.lit("old"), **{c: F.lit(f"mine {c}") for c in names}})
    got = line_dedup.deduplicate(docs, bits=bits)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names, "removed_lines"}
    found = got.collect()
    assert all(r[c] == f"mine {c}" for r in found for c in names)
    out = sorted(((r.doc_id, r.text, r.removed_lines) for r in found), key=repr)
    if bits == 128:  # other seeds cut elsewhere
        assert out == _brute_lines(rows)
    else:
        assert {r[0]: r[2] for r in out}[33] == 12
    assert line_dedup.deduplicate(make([])).count() == 0


def test_rows_without_id_are_told_apart_by_their_texts(make):
    shared = [f"shared {i}" for i in range(3)]
    texts = ["\n".join([f"own {k}", *shared, f"end {k}"]) for k in range(3)]
    got = line_dedup.deduplicate(make([(None, t) for t in (*texts, texts[0])])).collect()
    by = defaultdict(set)
    for r in got:
        by[r.text.split("\n")[0]].add(r.removed_lines)
    assert sorted(map(sorted, by.values())) == [[0], [3], [3]]  # repeated rows alike, and one text of three is first


def test_line_chunks_of_the_table(spark, hashes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    hashes(docs)
    got = QUERIES["op7_line_dedup"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.text, r.removed_lines) for r in got), key=repr) == _brute_lines(docs)


def test_repeated_lines_go(make):
    """Whole copies go whole; of runs inside different texts, all from nine lines on, and what the README states of shorter
    ones. Nothing else goes: what is removed stands somewhere before, as a run of lines."""
    rows, n, blocks = [], 0, {}
    for length in range(2, 21):
        for k in range(40):
            block = [f"run {length} {k} line {i}" for i in range(length)]
            for copy in range(2):
                own = [f"own {n} {i}" for i in range(9)]
                rows.append((n, "\n".join(own[: 1 + (k + copy) % 8] + block + own[1 + (k + copy) % 8 :])))
                blocks[n] = (length, block)
                n += 1
    for length in (1, 2, 3, 5, 10, 30):
        whole = "\n".join(f"copy {length} line {i}" for i in range(length))
        rows += [(n, whole), (n + 1, whole)]
        n += 2
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.deduplicate(make(rows)).collect()}
    whole = defaultdict(list)
    for doc_id, text in rows:
        if doc_id % 2 == 0 or "\n" not in text:
            assert got[doc_id] == (text, 0)
        elif doc_id not in blocks:
            assert got[doc_id] == ("", text.count("\n") + 1)
        else:
            length, block = blocks[doc_id]
            left = got[doc_id][0].split("\n")
            assert [x for x in left if x.startswith("own")] == [x for x in text.split("\n") if x.startswith("own")]
            kept = sum(x in block for x in left)
            assert kept in (0, length)  # edges are settled: all of a run goes, or nothing
            whole[length].append(kept == 0)
    share = {length: sum(x) / len(x) for length, x in whole.items()}
    print("share of runs removed by length:", share)
    assert all(share[k] == 1 for k in range(9, 21)) and share[8] >= 0.9 and share[6] >= 0.75 and share[5] >= 0.5 and share[4] >= 0.2


def _brute_spans(rows, sentences=span_dedup.SENTENCES, least=span_dedup.LEAST_WORDS):
    spans, first = [], {}
    for n, (doc_id, text) in enumerate(rows):
        text = text or ""
        starts = span_dedup.sentence_starts(text)
        words = [text[a:b].lower().split() for a, b in zip(starts, [*starts[1:], len(text)])]
        for i in range(len(words)):
            j = i + sentences
            while j <= len(words) and sum(map(len, words[i:j])) < least:
                j += 1
            if j <= len(words):
                key = tuple(" ".join(w) for w in words[i:j])
                rank = -1 if doc_id is None else doc_id
                spans.append((n, rank, i, j, key))
                first.setdefault((n, key), i)
    least_rank = {}
    for _, rank, _, _, key in spans:
        least_rank[key] = min(rank, least_rank.get(key, rank))
    gone = defaultdict(set)
    for n, rank, i, j, key in spans:
        if rank > least_rank[key] or i > first[(n, key)]:
            gone[n].update(range(i, j))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        starts = span_dedup.sentence_starts(text or "")
        parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text or "")])]
        left = "".join(p for i, p in enumerate(parts) if i not in gone[n])
        if gone[n]:
            text = left.rstrip() if len(parts) - 1 in gone[n] else left
        out.append((doc_id, text, len(gone[n])))
    return sorted(out, key=repr)


def test_sentence_spans(make, odd_rows, prose):
    passage = prose(90, 77).replace("\n", " ")
    unpunctuated = passage.replace(". ", " ").replace(", ", " ")
    rows = [(r[0], r[1]) for r in odd_rows] + [(40 + k, prose(70, 200 + k) + passage + prose(70, 300 + k)) for k in range(5)]
    rows += [(50, unpunctuated), (51, "other words first " + unpunctuated), (52, passage + passage), (53, "Ja! " * 70), (54, "Ja! " * 70)]
    docs = make(rows).withColumn("spans", F.lit(1)).withColumn("removed_sentences", F.lit("old"))
    got = span_dedup.deduplicate(docs)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "spans", "removed_sentences"}
    rows_out = [(r.doc_id, r.text, r.removed_sentences) for r in got.collect()]
    assert sorted(rows_out, key=repr) == _brute_spans(rows)
    by_id = {d: t for d, t, _ in rows_out}
    for k in range(1, 5):
        assert len(set(by_id[40 + k].split()) & set(passage.split())) < 12
    assert span_dedup.deduplicate(make([])).count() == 0


def _words(n, seed, marks=()):
    r = random.Random(seed)
    out = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n)]
    return [w + (r.choice(marks) if marks and r.random() < 0.25 else "") for w in out]


@pytest.mark.parametrize("marks", [(), (".", ",", ",", "!")])
@pytest.mark.parametrize("n", [50, 51, 60])
def test_every_passage_has_a_span_wherever_it_stands(n, marks):
    """Both texts have a span in common, though the sentences around the passage differ."""
    for seed in range(150):
        passage = _words(n, seed, marks)
        keys = []
        for side in (1, 2):
            text = " ".join(_words(seed * side % 23, 1000 * side + seed, marks) + passage + _words(seed // side % 19, 3000 * side + seed, marks))
            keys.append(set(zip(*map(np.ndarray.tolist, span_dedup.span_keys(text)))))
        assert keys[0] & keys[1]


def test_passages_without_marks_go(make):
    rows, passages = [], {}
    for k in range(60):
        passage = _words(51, 7000 + k)
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(_words(3 + k % 17 + 5 * side, 100 * k + side) + passage + _words(30 - k % 13, 9000 + 100 * k + side))))
        passages[2 * k + 1] = passage
    got = {r.doc_id: r.text.split() for r in span_dedup.deduplicate(make(rows)).collect()}
    for doc_id, passage in passages.items():
        assert len(set(passage) & set(got[doc_id])) <= 51 - 20
        assert set(got[doc_id]) | set(passage) == set(dict(rows)[doc_id].split())


def test_sentence_spans_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op9_substring_dedup"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.text, r.removed_sentences) for r in got), key=repr) == _brute_spans(docs)
    windows = Counter()
    for r in got:
        w = r.text.lower().split()
        windows.update({tuple(w[i : i + 60]) for i in range(len(w) - 59)})
    assert not any(n > 1 for n in windows.values())


def test_sketch_share_is_far_below_the_least_similarity():
    n, least = near_dedup.SKETCH, math.ceil(near_dedup.SKETCH_SHARE * near_dedup.SKETCH)
    missed = sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(least))
    print("sketch misses", missed)
    assert missed < 1e-7


NAMES = ("_at", "_doc", "_place", "_spans", "_id", "_hash", "_copy", "copies", "_rest", "_of", "taken", "place", "kept", "a.b", "`x`")


def test_other_columns_pass_through_whatever_they_are_called(make, odd_rows, prose):
    passage = prose(80, 5)
    rows = [r for r in odd_rows if len(r[1] or "") < 5000] + [(60, prose(30, 8) + passage), (61, passage + prose(30, 9)), (None, passage + prose(40, 7))]
    docs = make(rows).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.xxhash64("text").cast("string"), F.lit("none"))) for c in NAMES})
    for out in (span_dedup.deduplicate(docs).drop("removed_sentences"), near_dedup.without_near_duplicates(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(str(r[c]).startswith(f"{c} of ") for r in found for c in NAMES)
    sized = docs.withColumn("n", F.length("text"))
    mixed = mixing.mix(sized, "n")
    assert sorted(mixed.columns) == sorted({*sized.columns, "source_size", "target", "copies", "taken"})
    assert all(r["_rest"].startswith("_rest of ") for r in mixed.collect())


def test_passages_of_rows_without_id_go_once(make, prose):
    passage = " ".join(prose(90, 55).split())
    docs = make([(None, passage + " " + prose(25, 70 + k)) for k in range(3)])
    got = [r.removed_sentences for r in span_dedup.deduplicate(docs).collect()]
    assert sorted(got)[0] == 0 and sorted(got)[1] > 3
