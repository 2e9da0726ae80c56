"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.columns import REST, keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.llm.text import mixed, signed
from lowtide.session import materialise

#: Consecutive sentences and words that a span has at least.
SENTENCES = 3
LEAST_WORDS = 20
#: A sentence of more words is cut further, after the word of least hash in every REACH words.
LONG = 9
REACH = 6
WORD = re.compile(r"\S+")
#: What stands between sentences: white space after an end mark, line ends, and the place after a full-width end mark.
BETWEEN = re.compile(r"(?<=[.!?])\s+|\n\s*|(?<=[。！？])\s*")


def _clause_ends(words: list[str]) -> list[int]:
    """The words of a long sentence that end a clause: of every REACH neighbouring words the last one of least hash.

    Commas, semicolons and colons come before all hashes. What is a cut depends on REACH - 1 words on either side alone,
    and two cuts are at most REACH words apart.
    """
    rank = [-1 if w[-1] in ",;:" else xxhash.xxh3_64_intdigest(w.lower()) for w in words]
    out = []
    least = -1  # where the least rank of the last REACH words stands
    for i, r in enumerate(rank):
        if least <= i - REACH:
            least = i - REACH + 1
            for k in range(least + 1, i + 1):
                if rank[k] <= rank[least]:
                    least = k
        elif r <= rank[least]:
            least = i
        if i >= REACH - 1 and (not out or out[-1] != least):
            out.append(least)
    return out


def sentence_starts(text: str) -> list[int]:
    """Where sentences begin; each reaches to the next, with the white space in between.

    A sentence of more than LONG words is cut further, where its own words say so. Of a passage inside other text at most
    2 * REACH - 1 = 11 words on either side then stand before its first or after its last cut that does not depend on the
    text around it, and no sentence or clause between them has more than LONG words. So every passage of 50 words has
    within it three whole ones with 20 words.
    """
    ends = [m.end() for m in BETWEEN.finditer(text)]
    starts = []
    for a, b in zip([0, *ends], [*ends, len(text)]):
        if a < b and (not starts or a > starts[-1]):
            starts.append(a)
            words = list(WORD.finditer(text, a, b))
            if len(words) > LONG:
                starts += [words[i + 1].start() for i in _clause_ends([m.group() for m in words]) if i + 1 < len(words)]
    return starts


def span_ends(words: np.ndarray, sentences: int, least_words: int) -> np.ndarray:
    """The sentence after each span, given the words of each sentence: the shortest run from each sentence on with
    enough sentences and enough words. The last sentences, from which there is none, have no entry."""
    count = np.concatenate([[0], np.cumsum(words)])
    ends = np.maximum(np.arange(len(words)) + sentences, np.searchsorted(count, count[:-1] + least_words))
    return ends[ends <= len(words)]


def _rolled(h: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of the runs from each sentence to its end."""
    ratio = np.full(len(h) + 1, step, np.uint64)
    ratio[0] = 1
    power = np.multiply.accumulate(ratio)
    back = np.multiply.accumulate(np.concatenate([ratio[:1], np.full(len(h), pow(step, -1, 1 << 64), np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
    at = np.arange(len(ends))
    return mixed((total[ends] - total[at]) * back[at] + (ends - at).astype(np.uint64))


def span_keys(text: str, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key and a 32-bit check of the span from each sentence on; case and white space do not count."""
    starts = sentence_starts(text)
    words = [text[a:b].lower().split() for a, b in zip(starts, [*starts[1:], len(text)])]
    ends = span_ends(np.fromiter(map(len, words), np.int64, len(words)), sentences, least_words)
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for w in words), np.uint64, len(words))
    check = _rolled(mixed(h), ends, 0x2545F4914F6CDD1D) >> np.uint64(32)
    return signed(_rolled(h, ends, 0x9E3779B97F4A7C15)), check.astype(np.uint32).view(np.int32)


def spans(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, place, spans) for texts with spans: from each sentence on (key, check, whether the text has it earlier)."""
    kind = pa.struct([("key", pa.int64()), ("check", pa.int32()), ("again", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [span_keys(t or "", sentences, least_words) for t in batch.column(2).to_pylist()]
            again = []
            for key, check in found:
                once = np.ones(len(key), bool)
                once[np.unique(np.stack([key, check.astype(np.int64)]), axis=1, return_index=True)[1]] = False
                again.append(once)
            ends = np.cumsum([0] + [len(key) for key, _ in found])
            columns = [np.concatenate(c) if found else np.zeros(0) for c in ([f[0] for f in found], [f[1] for f in found], again)]
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(places, pa.int64()), lists], ["doc_id", "place", "spans"])

    types = "doc_id long, place long, spans array<struct<key:long,check:int,again:boolean>>"
    return docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(run, types).where("size(spans) > 0")


def repeated(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, place, spans): per document the first sentences of its spans that another place has first.

    A first count of 40 bits of the keys tells which spans may occur again; only those are compared by all 96 bits. Counts
    are added up before they move, and a frequent span is one row of the smaller side, so that adaptive execution can
    split the other.
    """
    # A stored row number stands for the document: it is narrow and, unlike a hash, compresses in the shuffle.
    stored = materialise(spans(docs, sentences, least_words).withColumn("row", F.monotonically_increasing_id()), "spans")
    every = stored.select("row", F.posexplode("spans").alias("at", "s")).select("row", "at", "s.*")
    once = every.where(~F.col("again"))
    bits = F.shiftrightunsigned("key", 24)
    more = once.groupBy(bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_bits")
    # Place and check share a column, and ranks follow later: few rows are left then.
    low = F.lit((1 << 32) - 1)
    tail = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("check").cast("long").bitwiseAND(low))
    left = once.select("row", "key", tail.alias("tail")).join(more, bits == F.col("_bits"))
    # Rows without id come first, by a hash of the text below zero: of different texts without id one is the first.
    rank = F.coalesce(F.col("doc_id"), F.least(F.col("place"), -1 - F.col("place")))
    left = left.join(stored.select("row", rank.alias("rank")), "row")
    left = left.select("row", "rank", "key", F.shiftright("tail", 32).cast("int").alias("at"), F.col("tail").bitwiseAND(low).alias("check"))
    left = materialise(left, "candidates")
    first = left.groupBy("key", "check").agg(F.min("rank").alias("_least"), F.max("rank").alias("_most"))
    several = first.where("_most > _least").select("key", "check", "_least")
    later = left.join(several, ["key", "check"]).where(F.col("rank") > F.col("_least")).select("row", "at")
    # What a text has earlier itself is known without the others.
    marked = later.unionByName(every.where("again").select("row", "at")).groupBy("row").agg(F.collect_set("at").alias("spans"))
    named = stored.select("row", "doc_id", "place").join(marked, "row")
    return named.groupBy("doc_id", "place").agg(F.first("spans").alias("spans"))  # repeated rows have the same


def without(text: str, first: list[int], sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> tuple[str, int]:
    """The text without the sentences of the spans that begin at ``first``, and their number."""
    starts = sentence_starts(text)
    bounds = list(zip(starts, [*starts[1:], len(text)]))
    ends = span_ends(np.array([len(text[a:b].split()) for a, b in bounds]), sentences, least_words)
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, ends[first], -1)
    gone = np.cumsum(edges[:-1]) > 0
    kept = "".join(text[a:b] for (a, b), g in zip(bounds, gone) if not g)
    return kept.rstrip() if gone[-1] else kept, int(gone.sum())


def deduplicate(docs: DataFrame, sentences: int = SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows, ``text`` without the sentences covered by a repeated span, and ``removed_sentences``.

    Sentences end after ``. ! ?`` before white space, at line ends, and after full-width end marks; those of more than
    9 words are cut into clauses. From each one on, the shortest run of at least ``sentences`` of them with at least
    ``least_words`` words is a span; spans are equal in everything but case
    and white space, by 96 bits of hash. The first place of a span stays: in the least ``doc_id`` (null ids count as
    negative ones that a hash of the text gives), the first one. Rows with equal ids count as one document, so neither removes from the other and repeated rows stay
    alike. Null and empty texts and those of fewer sentences stay as they are. A text that loses all its sentences
    becomes empty. Very long texts only have more spans. An empty table gives no rows. Other columns pass through,
    whatever they are called; one called ``removed_sentences`` is replaced.
    """
    found = repeated(docs.select("doc_id", "text"), sentences, least_words)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place"), F.col("spans").alias("_spans"))
    placed, names = keep_columns(docs, "doc_id", "text")
    placed = placed.withColumn("_at", F.xxhash64("text"))
    joined = placed.join(found, placed["doc_id"].eqNullSafe(found["_doc"]) & (placed["_at"] == found["_place"]), "left")
    joined = joined.select("doc_id", "text", REST, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(1).to_pylist(), [0] * batch.num_rows
            for i, first in enumerate(batch.column(3).to_pylist()):
                if first:
                    texts[i], n[i] = without(texts[i], first, sentences, least_words)
            columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", REST, "removed_sentences"])

    schema = joined.select("doc_id", "text", REST).schema.add("removed_sentences", "long")
    return put_back(joined.mapInArrow(run, schema), names, "removed_sentences")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of repeated spans."""
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
