"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.columns import keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.llm.text import word_count
from lowtide.operators.ordering import with_position
from lowtide.session import materialise

#: Words of the budget that the dynamic programming fits; longer budgets are first filled in proportion.
DP_WIDTH = 1 << 16
#: A source's words miss its target by no more than this share, or its documents may come more often.
NEAR = 0.002


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, width: int = DP_WIDTH) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can.

    Lengths are filled in proportion to their counts, then, long ones first, until about ``width`` words are open. A
    bounded knapsack over the documents still free fills the rest: ``by`` holds the length that first reached a sum, and
    only sums reached before that length are built upon, so walking back never takes a length more often than it occurs.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    open_words = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if open_words <= width:
            break
        more = min(int(counts[i] - taken[i]), (open_words - width) // int(lengths[i]))
        taken[i] += more
        open_words -= more * int(lengths[i])
    while open_words < 0:  # a rounding of the proportion
        i = next(i for i in order[::-1] if taken[i])
        taken[i] -= 1
        open_words += int(lengths[i])
    by = np.full(2 * open_words + 1, -1, np.int64)  # beyond twice the open words, nothing is nearer than none
    by[0] = len(lengths)
    for i in order:
        length, free = int(lengths[i]), int(counts[i] - taken[i])
        before = by >= 0
        if before[open_words]:
            break
        for k in range(1, min(free, 2 * open_words // length) + 1):
            sums = np.flatnonzero(before[: 2 * open_words + 1 - k * length]) + k * length
            sums = sums[by[sums] < 0]
            if not len(sums):
                break
            by[sums] = i
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.abs(reached - open_words).argmin()])
    while at:
        i = by[at]
        while at and by[at] == i:
            taken[i] += 1
            at -= int(lengths[i])
    return taken


def targets(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all words by weight, none above ``most`` times its source.

    Weights repeat over the sources in code-point order, null last. Sharing the excess again by weight until none is
    above ends in ``least(most * size, level * weight)``; the level rises until no further source reaches its cap. The
    driver sees one row of sums a round.
    """
    named = sources.withColumns({"_all": F.lit(0), "_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    table_ = materialise(
        with_position(named, ["_all"], ["_none", "_name"], "_i").select("source", "source_size", weight.alias("_w")), "sources"
    )
    cap = F.col("source_size") * float(most)
    level, capped = 0.0, -1
    while True:
        over = cap <= F.col("_w") * level
        s = table_.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)).alias("free"),
            F.count_if(over).alias("capped"),
        ).first()
        if s.capped == capped or not s.free:
            break
        capped, level = s.capped, max(level, (s.total - s.fixed) / s.free)
    return table_.select("source", "source_size", F.least(cap, F.col("_w") * level).alias("target"))


def mix(docs: DataFrame, size: str, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 17, id: str = "doc_id") -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to rows with ``source``, an id and a size.

    Documents are counted by exact size, and the copies of each size are chosen so that a source's words fit its target
    (see ``fit``): one group is a source's distinct sizes, however many rows it has. The documents of a source and size
    share their copies evenly; what is left over goes to those with the lowest seeded hash of the id. Ranks come from a
    range shuffle, so a hot source or size is spread over tasks. Reruns agree.

    A null source is a source of its own. A document without words has no copies and takes none.
    Rows that repeat an id and size are documents of their own, and any of them may be the one taken. A source of no
    words and an empty table have targets of 0 and no rows. Other columns pass through, whatever they are called; those of
    the added names are replaced.
    """
    added = ("source_size", "target", "copies", "taken")
    docs, names = keep_columns(docs, *dict.fromkeys((id, "source", size)))
    sizes = docs.groupBy("source", F.col(size).alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialise(sizes, "sizes")
    aims = targets(sizes.groupBy("source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size")), weights, most)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        lengths, counts = pdf["_size"].to_numpy(np.int64), pdf["_n"].to_numpy(np.int64)
        words = lengths > 0
        best, chosen = float("inf"), np.zeros(len(pdf), np.int64)
        # Copies are spread evenly; a document comes more often only where the target is not met otherwise.
        for copies in range(min(most, int(target // total) + 1), most + 1) if total else ():
            taken = np.zeros(len(pdf), np.int64)
            taken[words] = fit(lengths[words], counts[words] * copies, round(target))
            miss = abs(float((taken * lengths).sum()) - target)
            if miss < best:
                best, chosen = miss, taken
            if best <= NEAR * target:
                break
        return pd.DataFrame({"source": pdf["source"], "_size": lengths, "source_size": total, "target": target, "_passes": chosen // counts, "_extra": chosen % counts})

    known = sizes.join(aims, sizes["source"].eqNullSafe(aims["source"])).select(sizes["source"], "_size", "_n", "source_size", "target")
    plans = known.groupBy("source").applyInPandas(
        plan, "source string, _size long, source_size long, target double, _passes long, _extra long"
    )
    plans = materialise(plans.withColumn("_key", F.concat_ws(":", F.col("source").isNull().cast("string"), "source", "_size")).drop("source", "_size"), "plans")
    keyed = docs.withColumns({
        "_key": F.concat_ws(":", F.col("source").isNull().cast("string"), "source", size),
        "_draw": F.xxhash64(F.lit(seed), F.col(id)),
    })
    ranked = with_position(keyed, ["_key"], ["_draw", id], "_rank").join(plans, "_key")
    copies = F.col("_passes") + (F.col("_rank") < F.col("_extra")).cast("long")
    return put_back(ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col(size)), names, *added)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; those without words are left out.

    Only ids and sizes go through the ranking; texts are joined to their copies once. Rows that repeat an id, text and
    source go together: they are one document of all their words here, and each of them comes as often as it is taken.
    A null source is one of its own; an empty table gives no rows. Other columns pass through, whatever they are called.
    """
    rows, names = keep_columns(docs, "doc_id", "text", "source")
    rows = rows.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text", "source")})
    slim = rows.groupBy("source", "_id", "_hash").agg(F.sum(word_count("text")).alias("_words"))
    picked = mix(slim, "_words", id="_id", **options).where("taken > 0").select(F.col("_id").alias("_of"), F.col("_hash").alias("_with"), "copies")
    out = rows.join(picked, rows["_id"].eqNullSafe(picked["_of"]) & (rows["_hash"] == picked["_with"]))
    return put_back(out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))), names)


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1, none taken more than three times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken")
