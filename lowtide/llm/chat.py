"""Conversations as training windows: turn-aligned spans of a token budget, with a system turn, some history and a loss mask."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.operators.ordering import running_sum, with_position
from lowtide.session import materialise

#: Tokens of a window, and of the earlier turns that it repeats.
BUDGET = 2048
HISTORY = 256
#: Tokens that the marks of a turn count for.
MARKS = 4
#: Windows' worth of tokens that are cut together; a longer conversation is dealt into cells of so many.
CELL_WINDOWS = 16
BATCH_BYTES = 4 << 20

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Control strings of public chat templates. All of the first kind begin with "<|".
#   <|...   <s>   </s>   [INST]   [/INST]   <<SYS>>   <</SYS>>
CONTROL_TAIL = r"\||/?s>|/?INST\]|</?SYS>>"
#: It stands after the first character of a control string in a text; of such marks a text that has some already gets one more.
MARK = "\x1b"
_CONTROL = re.compile(rf"([<\[]{MARK}*)(?={CONTROL_TAIL})")
_ESCAPED = re.compile(rf"([<\[]{MARK}*){MARK}(?={CONTROL_TAIL})")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)


def escaped(text: str) -> str:
    """The text without control strings; ``unescaped`` gives it back, whatever it holds."""
    return _CONTROL.sub(r"\1" + MARK, text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]], repeated: int = 0, target: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The template's text for (role, text) turns, and (start, length) of each target's text after the ``repeated`` first
    turns, in code points of it."""
    parts, loss, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = TURN + escaped(role) + SAYS, escaped(text)
        if k >= repeated and role == target:
            loss.append((at + len(head), len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURNS.findall(text)]


def spans(tokens: list[int], budget: int, history: int, first: int = 0, fixed: int = 0, kept: bool = False) -> Iterator[tuple[int, int, int]]:
    """(first turn of the history, first new turn, turn after the last) of the windows of turns from ``first`` on.

    Prefix sums of the tokens tell how far a window reaches: as many new turns as fit beside ``fixed`` tokens and the
    history, one at least. The history is what fits of the turns before in ``history`` tokens and in what the first
    new turn leaves. ``kept`` says that turn 0 is a system turn, which every later window has in addition.
    """
    total = [0, *accumulate(tokens)]
    at = first
    while at < len(tokens):
        alone = kept and at == 0
        room = budget - (0 if alone else fixed)
        before = max(0, min(history, room - tokens[at]))
        low = at if alone else max(int(kept), bisect_left(total, total[at] - before))
        end = bisect_right(total, total[low] + room) - 1
        end = min(max(end, at + 1), len(tokens))
        yield low, at, end
        at = end


def _keyed(turns: DataFrame, tokens: Column | None) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    counted = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) if tokens is None else F.coalesce(tokens, F.lit(0))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
        (counted + MARKS).cast("long").alias("tokens"),
    )


KEY = ["conv", "nameless"]
PLACE = ["turn", "role", "tie"]


def _cells(rows: DataFrame, budget: int, history: int, system: str) -> DataFrame:
    """The rows with the cell that cuts them, and what they are in it: 0 the system turn of an earlier cell, 1 a turn
    before the cell's first that may be its history, 2 a turn of the cell.

    A conversation that one task may hold is a cell. Of the longer ones only ids, order and token counts go through the
    prefix sums, which are taken in blocks; texts move once more, to the cells.
    """
    width = CELL_WINDOWS * budget
    size = rows.groupBy(*KEY).agg(F.sum("tokens").alias("_all")).where(F.col("_all") > width)
    large = materialise(size.select(*KEY), "large")
    small = rows.join(large, KEY, "left_anti").withColumns({"cell": F.lit(0).cast("long"), "kind": F.lit(2)})
    if large.isEmpty():
        return small
    held = rows.join(large, KEY, "left_semi")
    placed = with_position(held.select(*KEY, *PLACE, "tokens"), KEY, PLACE)
    placed = running_sum(placed, KEY, "i", F.col("tokens"), "start", inclusive=False)
    placed = placed.withColumn("cell", F.floor(F.col("start") / width).cast("long"))
    placed = materialise(placed, "placed")
    own = placed.withColumn("kind", F.lit(2))
    # The last turns of a cell: the next turn begins where the cell ends, or later.
    near = F.col("start") >= (F.col("cell") + 1) * width - history
    before = placed.where(near).withColumns({"cell": F.col("cell") + 1, "kind": F.lit(1)})
    head = placed.where((F.col("i") == 0) & (F.col("role") == system) & (F.col("tokens") <= budget // 2))
    later = placed.where("cell > 0").select(*KEY, "cell").distinct()
    head = head.drop("cell").join(later, KEY).withColumn("kind", F.lit(0))
    parts = own.unionByName(before).unionByName(head).select(*KEY, *PLACE, "tokens", "cell", "kind")
    texts = held.groupBy(*KEY, *PLACE).agg(F.first("text").alias("text"))  # repeated rows share theirs
    return small.unionByName(parts.join(texts, [*KEY, *PLACE]).select(*small.columns))


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Column | None = None,
    system: str = "system",
    target: str = "assistant",
) -> DataFrame:
    """Training windows (conv_id, cell, window, text, loss, repeated, turns, tokens) of conversations (conv_id, turn, role, text).

    A window is a span of whole turns whose ``tokens`` (words and marks by default, and 4 for each turn's own marks) stay
    within ``budget``; a longer turn has a window of its own. Where the first turn is a system turn of at most half the
    budget, every window begins with it; then come the turns just before, up to ``history`` tokens. These ``repeated``
    turns are masked: ``loss`` has start and length of the texts of ``target`` turns that are new here, so each counts
    once. (cell, window) order the windows of a conversation. Control strings in roles and texts are escaped and
    ``read_turns`` gives them back.

    Turns go by ``turn``, null first, ties by role and a hash of the text; repeated rows are turns of their own. Null
    roles and texts are empty; rows without conv_id are one conversation. A conversation may have any number of turns,
    a turn any length. Other columns, whatever they are called, play no part. An empty table gives no rows.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must leave half of the budget")
    columns = [*KEY, "cell", "kind", "role", "text", "tokens"]
    rows = _cells(_keyed(turns, tokens), budget, history, system)
    rows = rows.repartition(*KEY, "cell").sortWithinPartitions(*KEY, "cell", "kind", *PLACE).select(*columns)
    fields = [
        ("conv_id", pa.int64()), ("cell", pa.int64()), ("window", pa.int64()), ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ("repeated", pa.int64()), ("turns", pa.int64()), ("tokens", pa.int64()),
    ]
    schema = pa.schema(fields)

    def cut(key: tuple, group: list[tuple]) -> Iterator[tuple]:
        conv, nameless, cell = key
        kept = group[0][0] == 0 or (cell == 0 and group[0][1] == system and group[0][3] <= budget // 2)
        first = sum(g[0] < 2 for g in group)
        count = [g[3] for g in group]
        for k, (low, at, end) in enumerate(spans(count, budget, history, first, count[0] if kept else 0, kept)):
            head = [0] if kept and at > 0 else []
            members = [*head, *range(low, end)]
            repeated = len(head) + at - low
            text, loss = formatted([group[m][1:3] for m in members], repeated, target)
            yield None if nameless else conv, cell, k, text, [dict(zip(("start", "length"), x)) for x in loss], repeated, len(members), sum(count[m] for m in members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, done, size = None, [], [], 0
        for batch in batches:
            for conv, nameless, cell, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv, nameless, cell) != key:
                    if group:
                        done += cut(key, group)
                    key, group = (conv, nameless, cell), []
                group.append(tuple(row))
                size += len(row[2])
                if size > BATCH_BYTES:
                    yield _batch(done, schema)
                    done, size = [], 0
        if group:
            done += cut(key, group)
        yield _batch(done, schema)

    return rows.mapInArrow(
        run, "conv_id long, cell long, window long, text string, loss array<struct<start:long,length:long>>, repeated long, turns long, tokens long"
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


def digests(found: DataFrame) -> DataFrame:
    """What is read back from windows: one row per conversation with digests of its turns and of all text under the mask.

    A digest of a whole conversation is one sequence of steps, so its windows pass one task in order; only a batch of
    them is in memory, and they are far fewer than the turns.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, begun = None, False
        n = chars = size = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv_id, text, spans_, repeated in zip(*[c.to_pylist() for c in batch.columns]):
                if begun and conv_id != conv:
                    rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    n = chars = size = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                conv, begun = conv_id, True
                for role, body in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans_:
                    said = unescaped(text[s["start"] : s["start"] + s["length"]])
                    loss.update(said.encode())
                    chars += len(said)
                size += len(text)
            yield _batch(rows, schema)
            rows = []
        if begun:
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        yield _batch(rows, schema)

    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "cell", "window")
    return ordered.select("conv_id", "text", "loss", "repeated").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


@query("op13_chat_windows")
def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted in windows and read back."""
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return digests(windows(given.unionByName(extra)))
