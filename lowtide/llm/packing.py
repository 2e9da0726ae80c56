"""Packing tokenised documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.llm.text import text_bytes
from lowtide.session import materialise

WINDOW = 4096
END_ID = 2
#: Pieces differenced together; the table is dealt into blocks of about this many.
BLOCK = 1024
#: Distinct words, and parts of words, whose ids a Python worker remembers; of the words the more used half then stays.
WORDS_KEPT = 400_000
PARTS_KEPT = 400_000
# The vocabulary's pattern for parts of words, and its characters for bytes (printable Latin-1 stands for
# itself, the other bytes follow from 256 on).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Words that the normaliser only lower-cases.
PLAIN = regex.compile(r"[!-~\u00A1-\u00AC\u00AE-\u024F]+")


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer cuts at white space before anything else, so the ids of a text are those of its words in order; each
    distinct word is encoded once and texts are put together by array lookups. Words of printable Latin characters are
    cut by the tokenizer's own pattern and given to its merge model part by part (its normaliser only lower-cases
    them); all others, and words with an added token's string, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)", regex.IGNORECASE)
        self.parts: dict[str, list[int]] = {}
        self._keep(np.zeros(0, np.int64))

    def _keep(self, at: np.ndarray) -> None:
        """Only the words numbered ``at`` stay."""
        if not len(at):
            self.number: dict[bytes, int] = {}
            self.count = self.start = self.used = np.zeros(0, np.int64)
            self.ids = np.zeros(0, np.uint32)
            return
        words = list(self.number)
        self.ids = self._gather(at)
        self.count, self.used = self.count[at], self.used[at]
        self.start = np.cumsum(self.count) - self.count
        self.number = {words[i]: k for k, i in enumerate(at.tolist())}

    def _gather(self, at: np.ndarray) -> np.ndarray:
        count = self.count[at]
        first = np.repeat(self.start[at] - (np.cumsum(count) - count), count)
        return self.ids[first + np.arange(len(first))]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > PARTS_KEPT:
                self.parts.clear()
            as_bytes = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            ids = self.parts[part] = array("I", [token.id for token in self.tokenizer.model.tokenize(as_bytes)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable() or PLAIN.fullmatch(word)) or self.added.search(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        return self._part(word) if word.isalpha() else b"".join(map(self._part, PARTS.findall(word)))

    def _learn(self, words: list[bytes]) -> None:
        coded = [self._word(w.decode()) for w in words]
        count = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.zeros_like(count)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), np.uint32)])

    def code(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += text.split()
            ends.append(len(words))
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list({words[i] for i in new}))
            at[new] = [self.number[words[i]] for i in new]
        ids = self._gather(at)
        cuts = np.concatenate([[0], np.cumsum(self.count[at])])[ends]
        self.used += np.bincount(at, minlength=len(self.used))
        if len(self.number) > WORDS_KEPT:
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[: WORDS_KEPT // 2]))
            self.used //= 2
        return [np.append(part, np.uint32(END_ID)) for part in np.split(ids, cuts[:-1])]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One coder per Python worker: what it has learned serves later tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document cut into full windows and a rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)

        def cut(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in schema]
            for doc_id, ids in zip(doc_ids, coder.code(texts) if texts else ()):
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    row = [doc_id, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids)]
                    for column, value in zip(rows, row + [part.astype(np.int32)] * with_ids):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                doc_ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
                if size > 1 << 21:
                    yield cut(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
            yield cut(doc_ids, texts)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, out)


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp multiway differencing: the window of each piece, and the largest sum.

    A partial partition is a row of sums in falling order with the pieces behind each. The two with the widest spread
    are merged, the largest sums of one onto the smallest of the other, until one is left; sums count from the least.
    """
    heap = []
    for i, length in enumerate(lengths.tolist()):
        heap.append((-length, i, [length], [[i]]))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # Only sums above the least are kept: what is missing up to `windows` is 0 with the pieces in `x[len(a):]`.
        free = windows - len(a)
        tied = max(0, len(b) - free)
        sums, parts = a[: len(a) - tied], x[: len(a) - tied]
        for k in range(tied):  # b's smallest kept sums meet a's smallest, crosswise
            j = len(b) - tied + k
            sums.append(a[len(a) - 1 - k] + b[j])
            parts.append(x[len(a) - 1 - k] + y[j])
        sums += b[: len(b) - tied]
        parts += y[: len(b) - tied]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, parts = [sums[k] for k in order], [parts[k] for k in order]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, tick, sums, parts))
        tick += 1
    out = np.zeros(len(lengths), np.int64)
    for k, part in enumerate(heap[0][3]):
        out[part] = k
    return out, heap[0][2][0]


def windows_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """The window of each piece; their number rises while the fullest one exceeds the capacity."""
    n = max(1, -(-int(lengths.sum()) // window))
    while True:
        out, most = difference(lengths, n)
        if most <= window:
            return out
        n += 1


def pack(cut: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces.

    Full pieces are windows of their own. The rest is dealt by a hash of the row number over blocks of about ``block``
    pieces, so repeated documents spread; a group is one block.
    """
    stored = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    names = [c for c in stored.columns if c != "_row"]
    full = stored.where(F.col("length") == window).select(*names, (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = stored.where(F.col("length") < window)
    blocks = max(1, -(-rest.count() // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", kind="stable", ignore_index=True)
        pdf["_w"] = windows_of(pdf["length"].to_numpy(np.int64), window)
        pdf = pdf.sort_values(["_w", "_row"], kind="stable", ignore_index=True)
        pdf["offset"] = pdf.groupby("_w")["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (pdf["_block"] * (1 << 20) + pdf["_w"]) * 2
        return pdf[[*names, "sequence_id", "offset"]]

    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema if f.name != "_row")
    packed = dealt.groupBy("_block").applyInPandas(run, f"{types}, sequence_id long, offset long")
    return full.unionByName(packed)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; with the ids on request.

    Ids are those of ``encode(text, add_special_tokens=False)``: the string of an added token in a text is that token.
    A null or empty text is one piece, its end id. Repeated rows are packed each for itself, null ids stay null, very
    long texts become full windows and a rest. An empty table gives no pieces.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces(docs, tokenizer, window, with_ids), window)


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
