"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.registry import query, table
from lowtide.llm.text import text_bytes

#: Bytes of context at most.
ORDER = 3
#: Documents of each language that the trees are grown from, about: a seeded draw, which bounds the size of the trees.
SAMPLE = 4000
#: Bytes looked at together.
BUFFER = 1 << 20
#: Costs held together: bytes times languages.
PLACES = 1 << 23
UNKNOWN = "und"
PAD = b"\n" * ORDER


def segments(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """A-Z lower-cased parts of a text, each after the ``ORDER`` bytes before it (line feeds before the first)."""
    data, size = PAD + data.lower(), size or BUFFER
    for lo in range(ORDER, len(data), size):
        yield data[lo - ORDER : lo + size]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each byte (the low 8 bits) follows each context of three, over all of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            columns = [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])

        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for part in segments(raw):
                    b = np.frombuffer(part, np.uint8).astype(np.uint32)
                    gram = b[ORDER:].copy()
                    for k in range(1, ORDER + 1):
                        gram |= b[ORDER - k : -k] << np.uint32(8 * k)
                    held.setdefault(lang, []).append(gram)
                if sum(map(len, held.get(lang, ()))) >= 4 * BUFFER:
                    yield counted(lang, held.pop(lang))
            for lang, parts in held.items():
                yield counted(lang, parts)

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where the entries of each begin, with the end of all."""
    keys, begin = np.unique(values, return_index=True)
    return keys.astype(np.uint32), np.append(begin, len(values)).astype(np.uint32)


def _entries(wanted: np.ndarray, keys: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``wanted``, entry) for all entries of the wanted values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    known = np.flatnonzero(keys[at] == wanted)
    lo, hi = begin[at[known]].astype(np.int64), begin[at[known] + 1].astype(np.int64)
    n = hi - lo
    first = np.cumsum(n) - n
    return np.repeat(known, n), np.arange(int(n.sum())) + np.repeat(lo - first, n)


class ContextTrees:
    """Frozen byte context trees of several languages, with exact code lengths.

    A byte is coded in the longest context that a language has seen, three bytes at most. A context met ``n`` times, with
    ``d`` different bytes, codes a byte met ``c`` times with probability (2c - 1) / 2n; any other byte pays for an escape,
    d / 2n, and is coded in the next shorter context, below the empty one as one of 256. A context that a language never
    met costs no escape.

    Only what a language has met is held: for each order, sorted strings of context and byte with the languages that
    have them and their code lengths, and sorted contexts with the languages' escapes, 6 bytes an entry and 8 a string.
    So the size follows the sum of the trees, of which the bounded sample of a language bounds each.
    """

    def __init__(self, langs: Sequence[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = list(langs)
        many = max(1, len(self.langs))
        self.orders = []
        for k in range(ORDER + 1):
            pairs, back = np.unique((gram & ((1 << 8 * (k + 1)) - 1)) * many + lang, return_inverse=True)
            count = np.bincount(back, weights=n, minlength=len(pairs))
            met, of = np.unique((pairs // many >> 8) * many + pairs % many, return_inverse=True)
            total = np.bincount(of, weights=count, minlength=len(met))
            kinds = np.bincount(of, minlength=len(met))
            codes = -np.log2((2 * count - 1) / (2 * total[of]))
            escapes = -np.log2(kinds / (2 * total))
            self.orders.append([
                (*_rows(keys // many), (keys % many).astype(np.uint16 if many <= 1 << 16 else np.int32), bits.astype(np.float32)) for keys, bits in ((pairs, codes), (met, escapes))
            ])

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for order in self.orders for table_ in order for a in table_)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four-byte string after the three before it, in each language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        still = np.ones(out.shape, bool)
        for k in range(ORDER, -1, -1):
            (strings, at_string, coder, bits), (contexts, at_context, leaver, escapes) = self.orders[k]
            here = grams & np.uint32((1 << 8 * (k + 1)) - 1)
            row, entry = _entries(here, strings, at_string)
            open_ = still[row, coder[entry]]
            row, entry = row[open_], entry[open_]
            out[row, coder[entry]] += bits[entry]
            still[row, coder[entry]] = False
            row, entry = _entries(here >> np.uint32(8), contexts, at_context)
            open_ = still[row, leaver[entry]]
            row, entry = row[open_], entry[open_]
            out[row, leaver[entry]] += escapes[entry]
        out[still] += 8
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language. Bytes are looked at together as far as their costs take PLACES numbers;
        each string of four bytes among them is costed once."""
        out = np.zeros((len(texts), len(self.langs)))
        most = max(1024, min(BUFFER, PLACES // max(1, len(self.langs))))
        owners: list[int] = []
        held: list[bytes] = []
        size = 0

        def add() -> None:
            b = np.frombuffer(b"".join(held), np.uint8).astype(np.uint32)
            gram = b[ORDER:].copy()
            for k in range(1, ORDER + 1):
                gram |= b[ORDER - k : -k] << np.uint32(8 * k)
            each, back = np.unique(gram, return_inverse=True)
            cost = self.costs(each)[back]
            ends = np.cumsum([len(h) for h in held]) - ORDER
            starts = ends - [len(h) - ORDER for h in held]
            # Sums alternate between a part and the ORDER bytes in front of the next.
            sums = np.add.reduceat(cost, np.ravel(np.column_stack([starts, ends]))[:-1], axis=0, dtype=np.float64)[::2]
            np.add.at(out, owners, sums)

        for i, text in enumerate(texts):
            for part in segments(text, min(most, BUFFER)):
                owners.append(i)
                held.append(part)
                size += len(part)
                if size >= most:
                    add()
                    owners, held, size = [], [], 0
        if held:
            add()
        return out


def learn(labelled: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> ContextTrees:
    """Trees of every language in (key, lang, text), grown from about ``sample`` documents of each.

    The draw hashes key and text, so rows without a key, or with one key, are drawn one by one. The driver gets one row per
    language and the counts of the trees as three numbers a row.
    """
    counts = labelled.where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("_docs")).collect()
    langs = sorted(r.lang for r in counts)
    docs = {r.lang: r["_docs"] for r in counts}
    spark = labelled.sparkSession
    known = spark.createDataFrame([(v, i, docs[v]) for i, v in enumerate(langs)], "lang string, _lang int, _docs long")
    draw = F.pmod(F.xxhash64(key, "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(known, "lang").where(draw < sample / F.col("_docs"))
    grams = gram_counts(drawn).join(known, "lang").select(F.col("_lang").alias("lang"), "gram", "n").toPandas()
    held = sorted(grams["lang"].unique())
    at = np.searchsorted(held, grams["lang"].to_numpy(np.int64))
    return ContextTrees([langs[i] for i in held], at, grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64))


def identify(docs: DataFrame, trees: ContextTrees, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every document with ``lang_pred`` and ``score``.

    The language of the shortest code wins, the first by name among equals; the score is its share when every bit of
    code length halves a language's weight. A text that is null or has no letter (Unicode category L) is ``und`` with
    score 0, as is every text where no language was learned. Whole texts are coded, very long ones part by part.
    Repeated rows are answered alike; null ids stay null; an empty table gives no rows. Columns that are not kept, whatever
    they are called, play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = list(text_bytes(batch.column(n)))
            letters = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model.langs and len(texts):
                bits = model.code_lengths([t if ok else b"" for t, ok in zip(texts, letters)])
                best = bits.argmin(axis=1)
                names[letters] = np.array(model.langs, object)[best[letters]]
                score[letters] = (1 / np.exp2(bits.min(axis=1)[:, None] - bits).sum(axis=1))[letters]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(n)), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"]
            )

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return docs.select(*keep, "text", letter).mapInArrow(run, f"{types}, lang_pred string, score double")


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by trees grown from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    trees = learn(docs.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"))
    return identify(docs, trees, ("doc_id", "held_out"))
