"""Spelling variants against plain comparison of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lowtide.llm import spelling
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = {a: a + 32 for a in range(65, 91)}


def _counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def _edits(word, letters):
    """All strings one edit away, over the given letters."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def _brute(counts, times=10):
    letters = set("".join(counts))
    near = {w: [x for x in _edits(w, letters) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


@pytest.mark.parametrize("letters, shortest, longest", [("ab", 1, 9), ("abcé", 7, 12), ("a", 1, 60)])
def test_all_pairs_of_random_words(spark, letters, shortest, longest):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(shortest, longest))) for _ in range(700)}
    counts = {w: r.choice([1, 2, 2, 3, 20, 30, 300, 4000]) for w in words}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 5, "x")]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long, node string"))
    want = {w: n for w, n in counts.items() if n >= 2}
    assert sorted(map(tuple, got.collect())) == _brute(want)


def test_long_words_and_odd_rows(make, odd_rows):
    base = "abcdefgh" * 2500  # 20,000 letters
    rows = [(r[0], r[1]) for r in odd_rows if r[1] is None or len(r[1]) < 5000]
    rows += [(100 + k, w + " " + w) for k, w in enumerate((base, base[:-1], base[1:], base[:9000] + "x" + base[9001:], base + "é"))]
    rows += [(200, "Straße×fern÷ straße×fern÷ ŁŁKanalnetz kanalnetz Kanal-Netzwerk"), (None, "übermorgen " * 40), (201, "übermorgn übermorgn ubermorgen ubermorgen")]
    rows += [(202 + k, "committee " * 30) for k in range(9)] + [(230, "comittee comittee commitee Commitee")]
    docs = make(rows).withColumns({c: F.lit("mine") for c in ("word", "n", "node", "at", "back", "id")})
    got = spelling.spelling_variants(docs, alter=spelling.planted).collect()
    want = Counter(_counts(rows))
    # Strings one edit away from very long words are not listed; those pairs are told here.
    assert {r.word: r.n for r in got} == want
    by_word = {r.word: r for r in got}
    for w, row in by_word.items():
        if len(w) < 100:
            assert row.n_near == sum(x in want for x in _edits(w, set("".join(x for x in want if len(x) < 100))))
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and any(a[:i] == b[:i] and (a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]) for i in (0, 9000, 19999, 19998, 20000))
    for a in (w for w in want if len(w) > 100):
        assert by_word[a].n_near == sum(near(a, b) for b in want if len(b) > 100)
    assert by_word["übermorgn"].form == "übermorgen" == by_word["ubermorgen"].root
    assert spelling.spelling_variants(make([])).count() == 0


def test_query_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = QUERIES["op12_spelling_variants"](spark, SMALL)
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    got = sorted(tuple(r) for r in df.collect())
    assert got == _brute(_counts(docs)) and sum(r[1] is not None for r in got) > 5
