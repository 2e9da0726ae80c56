"""Frequency-response and equaliser text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.sources.files import read_documents, stem


def parse_response(files: DataFrame) -> DataFrame:
    """(name, kind, f, db) of two-column text files (path, content). The first
    character of a file, unless alphanumeric or blank, marks its comments."""
    mark = F.substring("content", 1, 1)
    comment = F.when(~mark.rlike(r"[\p{Alnum}\s]"), mark)
    base = stem(F.col("path"))
    kind = F.regexp_extract(base, r"_(peak|avg)$", 1)
    lines = files.select(
        F.regexp_replace(base, r"(_filter)?_(peak|avg)$", "").alias("name"),
        F.when(base.rlike(r"_filter_(peak|avg)$"), F.concat(kind, F.lit("-filtered"))).otherwise(kind).alias("kind"),
        comment.alias("_c"), F.explode(F.split("content", r"\r?\n")).alias("_l"),
    )
    body = F.when(F.col("_c").isNull(), F.col("_l")).otherwise(F.call_function("substring_index", F.col("_l"), F.col("_c"), F.lit(1)))
    part = F.split(F.trim(body), r"\s+")
    rows = lines.select("name", "kind", F.get(part, F.lit(0)).try_cast("double").alias("f"), F.get(part, F.lit(1)).try_cast("double").alias("db"))
    return rows.where(F.col("f").isNotNull() & F.col("db").isNotNull())


def read_response(spark: SparkSession, path: str) -> DataFrame:
    return parse_response(read_documents(spark, path))


def response_rates(points: DataFrame) -> DataFrame:
    """The rate implied by each curve: twice its highest frequency."""
    return points.groupBy("name").agg((F.max("f") * 2).cast("int").alias("fs"))


def parse_equaliser(lines: DataFrame, fs: int = 48000) -> DataFrame:
    """(source, line_no, kind, fs, freq, q, gain) from lines of equaliser text; a
    leading ``Filter n:`` is allowed, other lines are ignored."""
    # Names of the text format.
    kinds = {"PK": "PeakingEQ", "LSC": "LowShelf", "HSC": "HighShelf", "AP": "AllPass"}
    part = F.split(F.trim(F.regexp_replace("line", r"^\s*Filter\s+\d+:\s*", "")), r"\s+")

    def parsed(part: Column) -> Column:
        at = lambda k: F.get(part, F.lit(k))
        name = F.lit(None).cast("string")
        for short, kind in kinds.items():
            name = F.when((at(0) == "ON") & (at(1) == short), kind).otherwise(name)
        name = F.when(at(0).rlike("^Preamp:?$"), "Gain").otherwise(name)
        return F.struct(
            name.alias("kind"), F.lit(fs).alias("fs"),
            F.when(at(0) == "ON", at(3).try_cast("double")).alias("freq"),
            F.when(at(1) == "AP", at(6).try_cast("double")).when(at(0) == "ON", at(9).try_cast("double")).alias("q"),
            F.when(at(0).rlike("^Preamp:?$"), at(1).try_cast("double")).when((at(0) == "ON") & (at(1) != "AP"), at(6).try_cast("double")).alias("gain"),
        )

    kept = [c for c in lines.columns if c != "line"]
    # A generator: each line is made, split and parsed once, whatever is selected or filtered later.
    known = F.filter(F.transform(F.array(part), parsed), lambda r: r["kind"].isNotNull())
    return lines.select(*kept, F.inline(known))
