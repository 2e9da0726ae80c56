"""Spelling variants: words one edit apart by a relational walk over tries, and the common form that each belongs to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, signed, text_bytes
from lowtide.session import materialise

#: A word has at least so many code points, and is used at least so often.
LEAST_LENGTH = 7
LEAST_USES = 2
#: A near word is the form of another where it is used so many times as often.
TIMES = 10
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
BATCH_ROWS = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, alter: Callable[[int | None], Callable[[str], str]] | None = None) -> DataFrame:
    """(word, n): the runs of ``[A-Za-z\\u00C0-\\u00FF]`` with at least ``least`` code points, A-Z lower-cased.

    ``alter(doc_id)`` may give a function that changes the runs of a document before they are counted.
    """
    long_runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                found = Counter(long_runs.findall(raw.lower().decode()))
                if alter is None:
                    total.update(found)
                else:
                    change = alter(doc_id)
                    for word, n in found.items():
                        word = change(word)
                        if len(word) >= least:
                            total[word] += n
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _prefixes(words: DataFrame) -> DataFrame:
    """(id, back, at, node, next) for words (id, word): the prefixes of each word, and of the word read backwards, from
    nearly its half on. ``node`` is a hash of the prefix and its direction, ``next`` the code point after it or -1."""
    fields = [("id", pa.int64()), ("back", pa.bool_()), ("at", pa.int32()), ("node", pa.int64()), ("next", pa.int32())]
    schema = pa.schema(fields)

    def rows(ids: list[int], words: list[str], back: bool) -> pa.RecordBatch:
        if back:
            words = [w[::-1] for w in words]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        which = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(codes)) - start[which]
        ratio = np.full(int(size.max()), _STEP, np.uint64)
        ratio[0] = 1
        weighed = mixed(codes.astype(np.uint64)) * np.multiply.accumulate(ratio)[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
        low = (size - 1) // 2
        n = size - low + 1  # prefixes of low to size code points
        which = np.repeat(np.arange(len(words)), n)
        at = np.arange(int(n.sum())) - (np.cumsum(n) - n)[which] + low[which]
        end = start[which] + at
        node = mixed(total[end] - total[start[which]] + mixed((2 * at + back).astype(np.uint64)))
        following = np.where(at < size[which], np.append(codes, 0)[end].astype(np.int64), -1)
        columns = [np.array(ids, np.int64)[which], np.full(len(at), back), at.astype(np.int32), signed(node), following.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and size < BATCH_ROWS:
                    size += len(words[hi])
                    hi += 1
                for back in (False, True):
                    yield rows(ids[lo:hi], words[lo:hi], back)
                lo = hi

    return words.select("id", "word").mapInArrow(run, "id long, back boolean, at int, node long, next int")


def tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (node, label, child, end) of a trie of all words and of one of all words read backwards, and the states
    (back, word, at, node, edits) in which words stand on their own paths.

    A node is a prefix after which words go on differently or one of them ends; an edge reaches to the next node or the
    end of a word, so its label may be long; ``child`` is null below a leaf, ``end`` the word that ends below the edge.
    Two words that differ in one edit agree in the first half of either or, read backwards, in the second; so the upper
    halves are left out.
    """
    prefixes = materialise(_prefixes(words), "prefixes")
    forks = prefixes.groupBy("node").agg(F.min("next").alias("_least"), F.max("next").alias("_most")).where("_least < _most").select("node")
    held = prefixes.join(forks, "node").groupBy("id", "back").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("nodes"))
    read = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    held = held.join(words.select("id", "word"), "id").select("back", read.alias("word"), "nodes")
    held = materialise(held.withColumn("size", F.length("word")), "nodes")

    steps = held.select("word", "size", "nodes", F.posexplode("nodes").alias("_k", "s"))
    child = F.get("nodes", F.col("_k") + 1)
    stop = F.coalesce(child["at"], F.col("size"))
    steps = steps.select(
        F.col("s.node").alias("node"),
        F.substring("word", F.col("s.at") + 1, stop - F.col("s.at")).alias("label"),
        child["node"].alias("child"),
        F.when(stop == F.col("size"), F.col("word")).alias("end"),
    ).where("label <> ''")
    edges = steps.groupBy("node", "label").agg(F.max("child").alias("child"), F.max("end").alias("end"))

    half = F.when(F.col("back"), F.col("size") - F.floor(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2))
    own = held.select("back", "word", F.explode(F.filter("nodes", lambda s: s["at"] >= half)).alias("s"))
    states = own.select("back", "word", F.col("s.at").alias("at"), F.col("s.node").alias("node"), F.lit(0).alias("edits"))
    return edges, states


def near_words(words: DataFrame) -> DataFrame:
    """(word, other), both ways, for words (id, word) that differ by one inserted, deleted or replaced code point.

    The frontier of states (word, position, node, edits) meets the edge table level by level. Without an edit, a word
    leaves its own path where an edge's label begins otherwise: the label has one code point more there, or another
    (only greater ones, since pairs are told both ways). With one edit, it must go on along a label as it stands. Where
    the word ends together with a word of the trie they are neighbours, which is compared once more in full.
    """
    edges, states = tries(words)
    edges = materialise(edges, "edges")
    rest = lambda skip: F.substring(F.col("word"), F.col("at") + F.lit(1 + skip), F.length("word"))
    tail = F.substring("label", F.lit(2), F.length("label"))
    # Code points compare as their UTF-8 bytes do.
    first, mine = F.substring("label", 1, 1), F.substring("word", F.col("at") + 1, F.lit(1))
    inserted = (F.col("edits") == 0) & (first != mine) & F.startswith(rest(0), tail)
    replaced = (F.col("edits") == 0) & (mine != "") & (first > mine) & F.startswith(rest(1), tail)
    along = (F.col("edits") == 1) & F.startswith(rest(0), F.col("label"))
    done = None
    while True:
        met = states.join(edges, "node").where(inserted | replaced | along)
        size = F.length("label")
        to = F.array(F.when(inserted, F.col("at") + size - 1), F.when(replaced | along, F.col("at") + size))
        met = met.withColumn("to", F.explode(F.array_compact(to))).select("back", "word", F.col("to").alias("at"), F.col("child").alias("node"), "end")
        ends = F.col("at") == F.length("word")
        met = materialise(met.where((ends & F.col("end").isNotNull()) | (~ends & F.col("node").isNotNull())), "frontier")
        here = met.where(ends & F.col("end").isNotNull()).select("back", "word", F.col("end").alias("other"))
        done = here if done is None else done.unionByName(here)
        states = met.where(~ends & F.col("node").isNotNull()).select("back", "word", "at", "node", F.lit(1).alias("edits"))
        if states.isEmpty():
            break
    pairs = done.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "other")])
    pairs = pairs.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()
    pairs = materialise(pairs.where(F.levenshtein("a", "b") == 1), "near")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form): where following forms ends. A form is used many times as often
    as its word, so there are few steps and no circles; each round doubles those made."""
    found = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        further = found.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        found = found.join(further, "root", "left")
        found = materialise(found.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
    return found.select("word", "root")


def group_variants(counts: DataFrame, times: int = TIMES, uses: int = LEAST_USES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words (word, n) used at least ``uses`` times.

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. ``form`` is the
    near word of greatest n (ties: the first by code points) where that is at least ``times`` times the word's n, else
    null; ``root`` is where following forms ends, the word itself without one. Null words are left out; of a repeated
    word the uses are added up. Words may be of any length and letters. An empty table gives no rows; other columns of
    ``counts``, whatever they are called, play no part.
    """
    if times < 2:
        raise ValueError("a form must be used more often than its word")
    known = counts.where("word IS NOT NULL AND word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= uses)
    known = materialise(known.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(known).join(known.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    out = known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    common = -F.col("best.m") >= F.col("n") * times
    out = out.select("word", "n", "n_near", F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.m")).alias("form_n"))
    out = materialise(out, "forms")
    out = out.join(_roots(out.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, times: int = TIMES, uses: int = LEAST_USES, alter=None) -> DataFrame:
    """``group_variants`` of the words of all texts. Null and empty texts have no words; repeated rows count again; null
    ids and other columns, whatever they are called, play no part; very long texts and words are read whole; an empty
    table gives no rows."""
    return group_variants(word_counts(docs, least, alter), times, uses)


def planted(doc_id: int | None) -> Callable[[str], str]:
    """The query's misspellings: by a hash of document and run, one run in 31 loses a code point."""
    if doc_id is None:
        return lambda word: word
    begun = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % 31:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1 :]

    return change


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, its common form and the last of the forms."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), alter=planted)
