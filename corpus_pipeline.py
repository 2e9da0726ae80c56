"""From raw documents to packed training sequences: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm import line_dedup, mixing, near_dedup, packing, quality
from lowtide.llm.columns import keep_columns, put_back
from lowtide.session import materialise

#: The stages cannot be told in SQL (sketches, rolling hashes, token ids); they are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose histograms are near a language reference of this input.

    Null and empty texts, and those of few words, go. Repeated rows are judged alike, null languages make no reference,
    very long texts are read whole. An empty table gives no rows. Other columns pass through, whatever they are called.
    """
    rows, names = keep_columns(docs, "doc_id", "text", "lang")
    # The row number keeps the optimizer from moving the test below the counts, where it would compute each of them anew
    # for every use.
    judged = quality.judge(rows, quality.references(rows)).withColumn("_row", F.monotonically_increasing_id())
    return put_back(judged.where("kept AND _row >= 0"), names)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated chunks of lines; those of which no word is left go. ``n_chars`` follows.

    What is left of a document stays even where it has few words now: the quality stage judged it as it came. Null and
    empty texts stay as they are. Ties, repeated rows, null ids and very long texts as in ``line_dedup.deduplicate``. An
    empty table gives no rows. Other columns pass through, whatever they are called.
    """
    rows, names = keep_columns(docs, "doc_id", "text", "n_chars")
    out = line_dedup.deduplicate(rows).where(r"removed_lines = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    return put_back(out.withColumn("n_chars", F.length("text").cast("long")), names)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Texts without words stay, each for itself; a null id stays only where its group has no other. Rows that repeat an
    id and text are one document. An empty table gives no rows. Other columns pass through, whatever they are called.
    """
    return near_dedup.without_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by source weights, each as often as it is taken.

    A null source is one of its own; texts without words are left out. Ties of a source and size are settled by a seeded
    hash of the id; repeated rows come together. An empty table gives no rows. Other columns pass through, whatever they are called.
    """
    return mixing.mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    A null or empty text is one piece, its end id; a very long text becomes full windows and a rest; each of several
    equal rows is packed for itself. An empty table gives no pieces. Other columns, whatever they are called, play no part.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
