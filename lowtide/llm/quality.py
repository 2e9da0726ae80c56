"""Quality rules: base counts of a text, and the divergence of its histograms from language references.

Everything here is column expressions; per-text work stays inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lowtide.llm.columns import keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.llm.text import WORD
from lowtide.session import materialise

SYMBOLS = "[#*$%&|<>]"
RUN = 8
#: Character classes in the order they are taken out of a text; what is left is the last class.
CLASSES = (r"[\p{Ll}\p{Lo}]+", r"\s+", r"\p{Lu}+", r"\p{N}+", r"""[.,;:!?'"()\-]+""")
COMMON_WORDS = 50


@dataclass(frozen=True)
class Limits:
    """Distances above which a text is rejected, each from a least number of units on."""

    characters: tuple[tuple[int, float], ...] = ((100, 0.30),)
    words: tuple[tuple[int, float], ...] = ((50, 0.45), (100, 0.40))
    least_words: int = 20
    repeat_percent: int = 30


def _shifted(column: str, by: int, combine) -> Column:
    """``combine`` of every element and the one ``by`` places later."""
    n = F.greatest(F.size(column) - by, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(1 + by), n), combine)


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole ``text`` (null: none).

    A window of 8 words is a hash put together in three doublings; only texts in which a hash occurs twice sort their
    windows to find the words covered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), 0)).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    for step in (1, 2, 4):
        out = out.withColumn("_h", _shifted("_h", step, lambda a, b: F.xxhash64(a, b)))
    several = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(several, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    out = out.withColumn("_e", _shifted("_s", 1, lambda a, b: a["x"] == b["x"]))
    no = F.array(F.lit(False))
    flagged = F.zip_with(F.zip_with(F.concat(no, "_e"), F.concat("_e", no), lambda p, n: p | n), "_s", lambda f, s: F.when(f, s["i"]))
    out = out.withColumn("_at", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_compact(flagged))))
    gaps = F.aggregate(_shifted("_at", 1, lambda a, b: F.least(b - a, F.lit(RUN))), F.lit(0), lambda s, x: s + x)
    repeat = F.coalesce(F.when(F.size("_at") > 0, gaps + RUN), F.lit(0)).cast("long")
    return out.withColumn("n_repeat_words", repeat).drop("_words", "_lines", "_h", "_s", "_e", "_at")


def with_classes(docs: DataFrame) -> DataFrame:
    """Adds ``_classes``, the characters of ``text`` in each class."""
    out = docs.withColumn("_r0", F.coalesce(F.col("text"), F.lit("")))
    for k, pattern in enumerate(CLASSES):
        out = out.withColumn(f"_r{k + 1}", F.regexp_replace(f"_r{k}", pattern, ""))
    left = [F.length(f"_r{k}").cast("double") for k in range(len(CLASSES) + 1)]
    counts = [a - b for a, b in zip(left, left[1:])] + [left[-1]]
    return out.withColumn("_classes", F.array(*counts)).drop(*[f"_r{k}" for k in range(len(CLASSES) + 1)])


def _letters(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}+"), 0)


def references(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, tuple[list[float], dict[str, float]]]:
    """Per language the shares of the character classes and of its ``common`` most frequent words, over all documents.

    Counts are added up before they move; the driver gets ``common`` words and one histogram a language.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    n = len(CLASSES) + 1
    shares = with_classes(known).groupBy("lang").agg(*[F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(n)])
    counts = known.select("lang", F.explode(_letters("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("_rank", rank).where(F.col("_rank") <= common).join(totals, "lang")
    words: dict[str, dict[str, float]] = {}
    for r in top.collect():
        words.setdefault(r.lang, {})[r.word] = r.n / r.total
    out = {}
    for r in shares.collect():
        total = sum(r[f"c{k}"] for k in range(n))
        if total and r.lang in words:
            out[r.lang] = ([r[f"c{k}"] / total for k in range(n)], words[r.lang])
    return dict(sorted(out.items()))


def _half(p: Column, q: Column) -> Column:
    """A bin's part of twice the Jensen-Shannon divergence, in bits."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return part(p, q) + part(q, p)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice, F.lit(0.0)) / 2)


def with_distances(docs: DataFrame, refs: dict[str, tuple[list[float], dict[str, float]]]) -> DataFrame:
    """Adds ``n_letter_words``, ``class_distance`` and ``word_distance``: each the least over the references.

    The word histogram of a text has a bin for each common word of a language and one for the rest. Words that no
    language lists are dropped first; a listed word that the text lacks adds its share, so only those present are
    visited: their number is bounded by the references, and the work by the text's length.
    """
    if not refs:
        return docs.withColumns({"n_letter_words": F.size(_letters("text")).cast("long"), "class_distance": F.lit(0.0), "word_distance": F.lit(0.0)})
    listed = sorted({w for _, words in refs.values() for w in words})
    out = with_classes(docs).withColumn("_w", _letters("text"))
    out = out.withColumns({"n_letter_words": F.size("_w").cast("long"), "_c": F.filter("_w", lambda w: w.isin(listed))})
    out = out.withColumn("_d", F.array_distinct("_c"))
    out = out.withColumn("_p", F.transform("_d", lambda w: F.size(F.filter("_c", lambda x: x == w)) / F.greatest(F.col("n_letter_words"), F.lit(1))))
    total = F.greatest(F.aggregate("_classes", F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    by_class, by_word = [], []
    for shares, words in refs.values():
        by_class.append(_distance(sum((_half(F.col("_classes")[k] / total, F.lit(s)) for k, s in enumerate(shares)), F.lit(0.0))))
        table_ = F.create_map(*[x for w, s in words.items() for x in (F.lit(w), F.lit(s))])
        mine = F.filter(
            F.zip_with("_d", "_p", lambda w, p: F.struct(p.alias("p"), F.try_element_at(table_, w).alias("q"))), lambda r: r["q"].isNotNull()
        )
        # (sum of the shares present, sum of the list's shares present, parts of the bins present)
        start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("d"))
        step = lambda s, r: F.struct((s["p"] + r["p"]).alias("p"), (s["q"] + r["q"]).alias("q"), (s["d"] + _half(r["p"], r["q"])).alias("d"))
        whole = sum(words.values())
        finish = lambda s: s["d"] + F.lit(whole) - s["q"] + _half(F.greatest(1 - s["p"], F.lit(0.0)), F.lit(max(0.0, 1 - whole)))
        by_word.append(_distance(F.aggregate(mine, start, step, finish)))
    return out.withColumns({
        "class_distance": F.array_min(F.array(*by_class)),
        "word_distance": F.array_min(F.array(*by_word)),
    }).drop("_classes", "_w", "_c", "_d", "_p")


def _over(distance: str, units: str, limits: Sequence[tuple[int, float]]) -> Column:
    out = F.lit(False)
    for least, most in limits:
        out = out | ((F.col(units) >= least) & (F.col(distance) > most))
    return out


def judge(docs: DataFrame, refs: dict[str, tuple[list[float], dict[str, float]]], limits: Limits = Limits()) -> DataFrame:
    """Adds the base counts, the distances, ``base_failed`` and ``kept`` to rows with ``text``.

    Null and empty texts have no words and fail the base rule. Texts under a limit's least number of characters or
    words are not judged by it; without references no text is rejected for its distances. Repeated rows are judged
    alike; an empty table gives no rows; other columns pass through, whatever they are called, but for those of the
    added names, which are replaced.
    """
    docs, names = keep_columns(docs, "text")
    out = with_distances(with_base(docs), refs)
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    bad = _over("class_distance", "word_chars", limits.characters) | _over("word_distance", "n_letter_words", limits.words)
    added = [c for c in out.columns if c not in docs.columns]
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~bad)
    return put_back(out, names, *added, "base_failed", "kept")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(limits: Limits = Limits()) -> str:
    """The same rules over exploded words, windows and bins."""
    half = lambda a, b: " + ".join(f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END)" for x, y in ((a, b), (b, a)))
    n = len(CLASSES) + 1
    left, text = [], "t"
    for pattern in CLASSES:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
        left.append(f"length({text})")
    kinds = ", ".join(f"{a} - {b} AS c{k}" for k, (a, b) in enumerate(zip(["length(t)", *left], [*left, "0"])))
    run = "word || " + " || ".join(f"' ' || lead(word, {k}) OVER o" for k in range(1, RUN))
    over = lambda d, u, ls: " OR ".join(f"({u} >= {least} AND {d} > {most})" for least, most in ls)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, text, t, regexp_extract_all(t, '{WORD}') AS words, regexp_extract_all(lower(t), '\p{{L}}+') AS letters,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORD}')] AS lines, {kinds} FROM d),
each AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
runs AS (SELECT rid, i, {run} AS g FROM each WINDOW o AS (PARTITION BY rid ORDER BY i)),
several AS (SELECT rid, i FROM runs WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM several, range({RUN}) AS r(k) GROUP BY rid),
counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(letters) AS word FROM w WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY ALL),
top AS (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q FROM counts QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON_WORDS}),
whole AS (SELECT lang, sum(q) AS s FROM top GROUP BY lang),
kinds AS (SELECT lang, {", ".join(f"sum(c{k}) / sum(length(t)) AS s{k}" for k in range(n))} FROM w WHERE text IS NOT NULL AND lang IN (SELECT lang FROM whole) GROUP BY lang),
p AS (SELECT rid, word, count(*) / any_value(len(letters)) AS p FROM (SELECT rid, letters, unnest(letters) AS word FROM w) GROUP BY rid, word),
present AS (SELECT rid, lang, sum(p) AS sp, sum(q) AS sq, sum({half("p", "q")}) AS sd FROM p JOIN top USING (word) GROUP BY rid, lang),
by_word AS (SELECT w.rid, min(sqrt(greatest(coalesce(sd, 0) + s - coalesce(sq, 0) + {half("greatest(1 - coalesce(sp, 0), 0)", "greatest(1 - s, 0)")}, 0) / 2)) AS d
  FROM w CROSS JOIN whole LEFT JOIN present ON present.rid = w.rid AND present.lang = whole.lang GROUP BY w.rid),
by_class AS (SELECT rid, min(sqrt(greatest({" + ".join(half(f"(c{k} / greatest(length(t), 1))", f"s{k}") for k in range(n))}, 0) / 2)) AS d FROM w CROSS JOIN kinds GROUP BY rid),
base AS (SELECT w.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(letters) AS n_letter_words
  FROM w LEFT JOIN covered ON covered.rid = w.rid),
judged AS (SELECT base.*, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed,
  coalesce(by_class.d, 0) AS cd, coalesce(by_word.d, 0) AS wd FROM base LEFT JOIN by_class ON by_class.rid = base.rid LEFT JOIN by_word ON by_word.rid = base.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT ({over("cd", "word_chars", limits.characters)} OR {over("wd", "n_letter_words", limits.words)}) AS kept
FROM judged"""


@query("op1_quality_rules", _sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, against references from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs.drop("lang"), references(docs)).select(*COLUMNS)
