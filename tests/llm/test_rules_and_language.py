"""Quality rules, URL verdicts, languages and the pipeline against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lowtide.llm import language, link_trust, near_dedup, quality
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _kinds(text):
    out, rest = [], text or ""
    for pattern in ("[a-zß-öø-ÿ぀-鿿]+", r"\s+", "[A-ZÀ-ÖØ-Þ]+", "[0-9²¼]+", r"""[.,;:!?'"()\-]+"""):
        less = re.sub(pattern, "", rest)
        out.append(len(rest) - len(less))
        rest = less
    return out + [len(rest)]


def _js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(0.0, total) / 2)


def _brute_quality(rows, limits=quality.Limits()):
    words, kinds = defaultdict(Counter), defaultdict(lambda: np.zeros(6))
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    for _, text, lang in rows:
        if lang is not None and text is not None:
            words[lang].update(letters(text))
            kinds[lang] += _kinds(text)
    refs = {}
    for lang, counts in words.items():
        if counts:
            top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
            refs[lang] = (kinds[lang] / kinds[lang].sum(), {w: n / sum(counts.values()) for w, n in top})
    out = {}
    for k, (doc_id, text, _) in enumerate(rows):
        base, w = _base(text), letters(text)
        mine, total = Counter(w), max(1, len(w))
        by_class = [_js(np.array(_kinds(text)) / max(1, len(text or "")), c) for c, _ in refs.values()]
        by_word = []
        for _, common in refs.values():
            p = [mine[x] / total for x in common]
            by_word.append(_js([*p, max(0, 1 - sum(p))], [*common.values(), max(0, 1 - sum(common.values()))]))
        failed = base[0] < limits.least_words or 100 * base[4] > limits.repeat_percent * base[0]
        bad = any(base[1] >= n and min(by_class) > m for n, m in limits.characters) or any(len(w) >= n and min(by_word) > m for n, m in limits.words)
        out[k] = (doc_id, *base, failed, not failed and not bad)
    return sorted(out.values(), key=repr)


def test_quality_of_the_table(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op1_quality_rules"](spark, SMALL)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect()]
    want = _brute_quality(docs)
    assert sorted(got, key=repr) == want
    assert {r[-1] for r in want if not r[-2]} == {True, False}


def test_quality_odd_rows(make, odd_rows, prose):
    twice = prose(30, 4).replace("\n", " ")
    rows = odd_rows + [(10, twice + " x " + twice, "en"), (11, "a b c d e f g h " * 3, "en"), (12, "SHOUT! " * 40, "en"), (13, "%% $$ " * 40, None)]
    docs = make(rows).withColumn("kept", F.lit("old")).withColumn("n_words", F.lit("old"))
    got = quality.judge(docs, quality.references(docs)).select(*quality.COLUMNS).collect()
    names = [r[:3] if len(r) > 2 else (*r, None) for r in rows]
    assert sorted(map(tuple, got), key=repr) == [(d, n, c, s, dup, rep, f, k) for d, n, c, s, dup, rep, f, k in _brute_quality(names)]
    unknown = quality.judge(make([(1, prose(60, 1))]), {}).first()
    assert unknown.kept and unknown.class_distance == 0
    assert quality.references(make([])) == {} and quality.judge(make([]), {}).count() == 0


def _brute_rank(edges, seeds, steps=400, d=link_trust.DAMPING):
    out = Counter()
    for src, dst, n in edges:
        out[src] += n
    x = {h: m * (1 - d) for h, m in seeds.items()}
    score = Counter(x)
    for _ in range(steps):
        following = Counter()
        for src, dst, n in edges:
            following[dst] += x.get(src, 0) * n / out[src] * d
        x = following
        score.update(x)
    return score


def test_trust_walks_along_and_distrust_against_the_links(spark):
    page = lambda i, url, *links: (i, url, "".join(f"<a href='{x}'>x</a>" for x in links))
    rows = [
        page(1, "https://good.org/a", "https://friend.net/x", "/own"),
        page(2, "https://friend.net/x", "//far.net/y"),
        page(3, "https://far.net/y"),
        page(4, "https://bad.com/de/1", "/z"),
        page(5, "HTTP://Booster.NET/b?x#y", "https://BAD.com/de/1", "https://bad.com/de/2"),
        page(6, "https://second.net/", "https://booster.net/b"),
        page(7, "https://alone.net", "mailto:someone@bad.com"),
        (8, None, None), (9, "no host", "<a href=https://bad.com/>"), (10, "https://www.example.org/en/15", None),
        page(3, "https://far.net/y"), (None, "https://x.EXAMPLE.org/es/?q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("old")).withColumn("trust", F.lit(1))
    got = {(r.page_id, r.url): r for r in link_trust.judge(pages).collect()}
    verdicts = {k[0]: (r.rule, r.verdict) for k, r in got.items()}
    assert len(got) == 11
    assert verdicts[1] == ("org/", "allow") and verdicts[4] == ("com/de/", "block")
    assert verdicts[10] == ("example.org/en/1", "block") and verdicts[None] == ("example.org/es/", "block")
    assert all(verdicts[i] == (None, "allow") for i in (2, 3, 7, 8, 9))
    assert all(verdicts[i] == (None, "block") for i in (5, 6))
    assert got[(5, rows[4][1])].host == "booster.net" and got[(5, rows[4][1])].path == "/b" and got[(8, None)].host == ""
    edges = [("good.org", "friend.net", 1), ("good.org", "good.org", 1), ("friend.net", "far.net", 1), ("bad.com", "bad.com", 1), ("booster.net", "bad.com", 2), ("second.net", "booster.net", 1)]
    trust = _brute_rank(edges, {"good.org": 1.0})
    distrust = _brute_rank([(b, a, n) for a, b, n in edges], {"bad.com": 1 / 3, "www.example.org": 1 / 3, "x.example.org": 1 / 3})
    for (_, _), r in got.items():
        if r.host:
            assert (r.trust or 0) == pytest.approx(trust[r.host]) and (r.distrust or 0) == pytest.approx(distrust[r.host])
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert link_trust.judge(empty).count() == 0


def test_walks_go_on_as_long_as_they_reach_further_hosts(spark):
    """A path of 40 hosts to one blocked seed, with links of the hosts to themselves, and a ring."""
    name = lambda k: f"https://h{k}.net/"
    rows = [(0, "https://bad.com/de/", "")]
    rows += [(k, name(k), f"<a href='{name(k - 1) if k > 1 else 'https://bad.com/de/'}'>x</a>" + "<a href=/own>" * (k % 3)) for k in range(1, 41)]
    rows += [(100 + k, f"https://r{k}.net/", f"<a href='https://r{(k + 1) % 5}.net/'><a href=/a>") for k in range(5)]
    rows += [(200, "https://seed.org/", "<a href='https://r0.net/'>"), (201, "https://apart.net/", "<a href=/a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(f"mine {c}") for c in ("_says", "w", "x", "score", "_rest")})
    got = {r.page_id: r for r in link_trust.judge(pages).collect()}
    assert {got[k].verdict for k in range(41)} == {"block"} and all(got[k].distrust > 0 for k in range(41))
    assert {got[k].verdict for k in (200, 201, *range(100, 105))} == {"allow"}
    assert all(r[c] == f"mine {c}" for r in got.values() for c in ("_says", "w", "x", "score", "_rest"))
    edges = [(f"r{k}.net", f"r{(k + 1) % 5}.net", 1) for k in range(5)] + [(f"r{k}.net", f"r{k}.net", 1) for k in range(5)] + [("seed.org", "r0.net", 1)]
    want = _brute_rank(edges, {"seed.org": 1.0})
    for k in range(5):
        assert got[100 + k].trust == pytest.approx(want[f"r{k}.net"], rel=1e-5)


def test_languages_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert len(test) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test) >= 0.98


class _PlainPPM:
    """The same model, followed byte by byte through dictionaries."""

    def __init__(self, texts):
        self.counts = [defaultdict(Counter) for _ in range(4)]
        for t in texts:
            data = b"\n\n\n" + t.encode().lower()
            for i in range(3, len(data)):
                for k in range(4):
                    self.counts[k][data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data = b"\n\n\n" + text.encode().lower()
        total = 0.0
        for i in range(3, len(data)):
            for k in (3, 2, 1, 0):
                seen = self.counts[k].get(data[i - k : i])
                if seen is None:
                    continue
                n = sum(seen.values())
                if data[i] in seen:
                    total -= math.log2((2 * seen[data[i]] - 1) / (2 * n))
                    break
                total -= math.log2(len(seen) / (2 * n))
            else:
                total += 8
        return total


def test_code_lengths_are_exact(make, prose, odd_rows, monkeypatch):
    monkeypatch.setattr(language, "BUFFER", 257)  # texts go through in many parts
    train = {"aa": [prose(80, 1), "the and of"], "bb": ["ñandú über 日本 " * 3, prose(20, 2).upper()]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    trees = language.learn(make(rows))
    assert trees.langs == ["aa", "bb"]
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 5000] + ["the ñandú\x00\xff", prose(70, 1)]
    bits = trees.code_lengths([t.encode() for t in texts])
    for i, lang in enumerate(trees.langs):
        plain = _PlainPPM(train[lang])
        assert bits[:, i] == pytest.approx([plain.bits(t) for t in texts], rel=1e-5)


def test_languages_odd_rows(make, odd_rows):
    docs = make(odd_rows).withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(0))
    trees = language.learn(docs.where("lang IS NOT NULL AND text IS NOT NULL"))
    got = language.identify(docs, trees).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and (r.score == 0) == (r.lang_pred == "und")
    none = language.learn(make([]))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(make([]), trees).count() == 0


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = [r for r in docs.collect()]
    columns = docs.columns
    out, rows = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = near_dedup.materialise(stage(spark, docs, SMALL), "stage")
        out[name] = docs
        rows[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    good = {r[0] for r in _brute_quality([(r.doc_id, r.text, r.lang) for r in before]) if r[-1]}
    assert {r.doc_id for r in rows["quality_rules"]} == good and len(rows["quality_rules"]) == len(good)
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in rows["line_dedup"])
    from tests.llm.test_near_and_lines import _brute_components, _brute_lines, learn_hashes

    learn_hashes(spark, [(r.doc_id, r.text) for r in rows["quality_rules"]])
    lines = {d: t for d, t, _ in _brute_lines([(r.doc_id, r.text) for r in rows["quality_rules"]]) if t.strip()}
    assert {r.doc_id: r.text for r in rows["line_dedup"]} == lines
    stay = {d for d, _, _, k in _brute_components(list(lines.items())) if k}
    assert {r.doc_id for r in rows["near_dedup"]} == stay
    assert {r.doc_id for r in rows["mixing"]} <= stay and max(Counter(r.doc_id for r in rows["mixing"]).values()) <= 3
    tokens = Counter()
    for r in rows["packing"]:
        tokens[r.doc_id] += r.length
    whole = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    copies = Counter(r.doc_id for r in rows["mixing"])
    assert tokens == Counter({d: n * whole[d] for d, n in copies.items()})
    assert corpus_pipeline.run(spark, SMALL).count() == len(rows["packing"])


def test_no_scrap_of_a_copy_reaches_packing(spark, make):
    """Exact copies of documents of 2, 3, 5 and 10 lines; all that is mixed and packed is of the first ones."""
    rows, firsts = [], set()
    for k in range(40):
        length = (2, 3, 5, 10)[k % 4]
        text = "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(9)) for i in range(length))
        firsts.add(100 + k)
        rows += [(100 + k + 1000 * copy, text, "en", "abc"[copy]) for copy in range(3)]
    docs = make(rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = near_dedup.materialise(stage(spark, docs, SMALL), "stage")
        if name == "line_dedup":
            assert {(r.doc_id, r.text) for r in docs.collect()} == {(r[0], r[1]) for r in rows if r[0] < 1000}
    assert {r.doc_id for r in docs.collect()} <= firsts and docs.count()


def test_stages_with_odd_rows_and_other_columns(spark, make, odd_rows, prose):
    names = ("kept", "_row", "_w", "n_words", "removed_lines", "_at", "_lines", "_id", "_copy", "copies", "_rest", "_spans")
    odd = [r for r in odd_rows if len(r[1] or "") < 5000]
    docs = make(odd + [(20 + k, prose(200, k), "en", None) for k in range(4)]).withColumns({c: F.lit(f"mine {c}") for c in names})
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            found = out.collect()
            assert all(r[c] == f"mine {c}" for r in found for c in names)
            if name == "near_dedup":  # null and blank texts stay
                assert len(found) == 0 or {1, 2, 3} <= {r.doc_id for r in found}
            if name == "line_dedup" and found:
                assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    last = corpus_pipeline.STAGES[-1][1]
    packed = last(spark, docs, SMALL).collect()
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in docs.select("doc_id").collect()})
    assert last(spark, docs.where("false"), SMALL).count() == 0


def test_models_of_many_languages_stay_small(make, monkeypatch):
    """Sixty made languages: what is held follows what each has met, not contexts times bytes times languages."""
    r = np.random.default_rng(8)
    n = 60
    lang, gram, count = [], [], []
    for i in range(n):  # about 200,000 strings of four bytes each, over letters of its own
        letters = r.choice(np.arange(32, 256), 60, replace=False)
        b = letters[r.integers(0, 60, (200_000, 4))].astype(np.int64)
        u, c = np.unique(b[:, 0] << 24 | b[:, 1] << 16 | b[:, 2] << 8 | b[:, 3], return_counts=True)
        lang.append(np.full(len(u), i)), gram.append(u), count.append(c.astype(float))
    trees = language.ContextTrees([f"l{i:02}" for i in range(n)], np.concatenate(lang), np.concatenate(gram), np.concatenate(count))
    assert trees.nbytes < 500e6
    monkeypatch.setattr(language, "PLACES", 1 << 18)
    texts = [bytes(((gram[i][:50, None] >> np.array([24, 16, 8, 0])) & 255).astype(np.uint8).ravel()) for i in (3, 31)]
    got = trees.code_lengths([*texts, b""])
    assert got.shape == (3, n) and got[:2].argmin(axis=1).tolist() == [3, 31] and not got[2].any()


def test_rows_of_one_id_are_drawn_one_by_one(make, prose):
    rows = [(None, prose(30, k), "aa") for k in range(200)] + [(5, prose(30, 1000 + k), "bb") for k in range(200)]
    trees = language.learn(make(rows), sample=50)
    assert trees.langs == ["aa", "bb"]
