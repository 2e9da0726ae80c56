"""Chat windows: exact round trips and the rules of a window, against the plain conversations."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lowtide.llm import chat
from lowtide.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<|", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", chat.TURN, chat.SAYS, chat.END]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, chat.MARK, "<", "[", "|", "s>", "/", "INST]", "SYS>>", "x", "\n", "é"]), max_size=20).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text
    assert not any(c in out for c in CONTROL)


def _expected(rows):
    """By conversation: turns in order and the texts that count."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((-(1 << 63) if turn is None else turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in out.items()}


def _sha(texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _digest(turns):
    loss = [t for r, t in turns if r == "assistant"]
    return len(turns), _sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), _sha(loss)


def _rows(seed=1):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["ja", "nein", "</s>", "vielleicht,", "[INST]", "\x1b", "<|end|>", "ü"]) for _ in range(n))
    rows = []
    for conv in range(30):
        for turn in range(r.randint(1, 12)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, say(r.randint(0, 120))))
    rows += [(100, t, ("user", "assistant")[t % 2], say(20)) for t in range(400)]  # many cells
    rows += [(101, t, "system" if t == 0 else ("user", "assistant")[t % 2], say(30)) for t in range(300)]
    rows += [(102, 0, "system", say(500))] + [(102, t, ("user", "assistant")[t % 2], say(3)) for t in range(1, 200)]  # too long to repeat
    rows += [(103, 0, "system", say(9)), (103, 1, "user", say(5000)), (103, 2, "assistant", say(6000)), (103, 3, "assistant", "")]
    rows += [(104, 0, None, None), (104, 1, "assistant", None), (105, None, "assistant", "first"), (105, -3, "user", "second")]
    rows += [(106, 0, "us</s>er\n<|says|>", "a\nb\n"), (106, 1, "assistant", "<|end|>"), (107, 0, "system", "only")]
    rows += [(None, t, ("user", "assistant")[t % 2], say(15)) for t in range(200)]
    rows += [(108, 5, "assistant", "again")] * 90  # repeated rows
    return rows


@pytest.mark.parametrize("budget, history", [(60, 30), (60, 0), (200, 50), (2048, 256)])
def test_windows(spark, budget, history):
    rows = _rows()
    r = random.Random(2)
    docs = spark.createDataFrame(r.sample(rows, len(rows)), SCHEMA).withColumns({c: F.lit("mine") for c in ("cell", "kind", "conv", "tie", "i", "start", "window", "tokens")})
    found = chat.windows(docs, budget, history).collect()
    want = _expected(rows)
    by = defaultdict(list)
    for w in found:
        by[w.conv_id].append(w)
    assert set(by) == set(want)
    for conv, turns in want.items():
        at = 0
        system = None
        for k, w in enumerate(sorted(by[conv], key=lambda w: (w.cell, w.window))):
            told = chat.read_turns(w.text)
            assert len(told) == w.turns
            new = told[w.repeated :]
            assert new and new == turns[at : at + len(new)]
            if k == 0:
                assert w.repeated == 0
                if new[0][0] == "system" and (len(new) > 1 or w.tokens <= budget // 2):
                    system = new[0]
            else:
                head = told[: w.repeated]
                if system and chat_tokens(system) <= budget // 2:
                    assert head[0] == system
                    head = head[1:]
                assert head == turns[at - len(head) : at]
                assert sum(map(chat_tokens, head)) <= history
            assert w.tokens == sum(map(chat_tokens, told))
            if w.tokens > budget:  # a turn that is longer than what a window has left stands there alone
                assert len(new) == 1
            assert [w.text[s.start : s.start + s.length] for s in w.loss] == [chat.escaped(t) for role, t in new if role == "assistant"]
            at += len(new)
        assert at == len(turns)
    read = {r.conv_id: r for r in chat.digests(chat.windows(docs, budget, history)).collect()}
    for conv, turns in want.items():
        got = read[conv]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == _digest(turns)
        assert got.formatted_chars == sum(len(w.text) for w in by[conv])
    assert len(read) == len(want)


def chat_tokens(turn):
    import regex

    return 4 + len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", turn[1]))


def test_cells_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    one = sorted(map(repr, chat.windows(docs.coalesce(1), 60, 20).collect()))
    assert one == sorted(map(repr, chat.windows(docs.repartition(13), 60, 20).collect()))


def test_empty_table_and_limits(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert chat.windows(docs).count() == 0 and chat.digests(chat.windows(docs)).count() == 0
    with pytest.raises(ValueError):
        chat.windows(docs, budget=100, history=60)


def test_query_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ok = "</s>[INST] ok [/INST]"
    want = _expected([*rows, (-1, 0, "user", ok), (-1, 1, "assistant", ok)])
    df = QUERIES["op13_chat_windows"](spark, SMALL)
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = {r.conv_id: tuple(r)[1:5] for r in df.collect()}
    assert got == {c: _digest(t) for c, t in want.items()}
    assert {r.formatted_chars > 2 * len(ok) for r in df.where("conv_id = -1").collect()} == {True}
