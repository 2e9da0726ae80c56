"""Text and JSON exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lowtide.functions.text import general, to_places
from lowtide.sinks.grouped import write_files
from lowtide.sources.documents import KIND_OF

TIMES = ("duration_seconds", "start_seconds", "duration_hhmmss", "start_hhmmss")
TYPE_OF = {v: k for k, v in KIND_OF.items()}


def response_lines(curves: DataFrame, signals: DataFrame) -> DataFrame:
    """(signal_id, kind, line_no, value): a ``#`` header and two fixed-width columns.
    ``signals`` has (signal_id, fs)."""
    w = Window.partitionBy("signal_id", "kind").orderBy("f")  # one bounded grid
    body = curves.select(
        "signal_id", "kind", (F.row_number().over(w) + 2).cast("long").alias("line_no"),
        F.format_string("%8.3f %8.3f", to_places(F.col("f")), to_places(F.col("db"))).alias("value"),
    )
    kinds = curves.select("signal_id", "kind").distinct().join(signals, "signal_id")
    head = F.array(
        F.concat(F.lit("# Signal Name: "), F.col("signal_id").cast("string")),
        F.concat(F.lit("# Fs: "), F.col("fs").cast("string")), F.lit("# frequency magnitude"),
    )
    top = kinds.select("signal_id", "kind", F.posexplode(head).alias("line_no", "value"))
    return top.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body)


def write_responses(lines: DataFrame, path: str) -> None:
    """A text file for each curve, ``<signal>_<kind>.frd``; all of them appear when all are written."""
    name = F.concat_ws("_", F.col("signal_id").cast("string"), "kind")
    write_files(lines, path, name, F.col("value"), ["line_no"], extension=".frd")


def filter_json(kind: Column, columns: Sequence[str] = ()) -> Column:
    """JSON of one filter row (fs, freq, q, gain, n), with the fields its kind has. ``columns`` names the table's columns
    where it also holds Linkwitz transforms (f0, q0, fp, qp) or compound passes (family, order)."""
    name = F.lit(None).cast("string")
    for k, t in TYPE_OF.items():
        name = F.when(kind == k, t).otherwise(name)
    gained, stacked = kind.isin("PeakingEQ", "LowShelf", "HighShelf"), kind.isin("LowShelf", "HighShelf")
    tuned = gained | kind.isin("LowPass2", "HighPass2", "AllPass")
    compound = kind.isin("ComplexLowPass", "ComplexHighPass")
    extra = [F.when(kind == "LinkwitzTransform", F.col(n)).alias(n) for n in ("f0", "fp", "q0", "qp") if n in columns]
    extra += [F.when(compound, F.col(c)).alias(n) for c, n in (("family", "filter_type"), ("order", "order")) if c in columns]
    return F.to_json(F.struct(
        name.alias("_type"), F.col("fs").alias("fs"),
        F.when(tuned | kind.isin("LowPass1", "HighPass1"), F.round("freq", 2)).when(compound, F.col("freq")).alias("fc"),
        F.when(tuned, F.col("q")).alias("q"), F.when(gained | (kind == "Gain"), F.round("gain", 3)).alias("gain"),
        F.when(stacked, F.col("n")).alias("count"), *extra,
    ))


def filter_set_json(filters: DataFrame, by: str = "filter_set_id", description: str = "Combined") -> DataFrame:
    """One document per set, its filters in ``seq`` order."""
    rows = filters.select(by, "seq", "fs", filter_json(F.col("kind"), filters.columns).alias("j"))
    docs = rows.groupBy(by).agg(F.first("fs").alias("fs"), F.array_sort(F.collect_list(F.struct("seq", "j")))["j"].alias("j"))
    text = F.concat(
        F.lit(f'{{"_type":"CompleteFilter","description":{json.dumps(description)},"fs":'), F.col("fs").cast("string"),
        F.lit(',"filters":['), F.array_join("j", ","), F.lit("]}"),
    )
    return docs.select(by, text.alias("content"))


def _quoted(c: Column) -> Column:
    """A JSON string, escaped as the writer of structs does; null stays null."""
    whole = F.to_json(F.struct(c.alias("v")))  # {"v":...}
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def signal_json(signals: DataFrame, curves: DataFrame) -> DataFrame:
    """(signal_id, content): name, rate, curves rounded to six places, filter, links.
    ``signals`` has (signal_id, fs, offset_db, filter_json, master_name, slave_names) and, where known, the texts
    duration_seconds, start_seconds, duration_hhmmss, start_hhmmss and the struct metadata."""
    points = F.array_sort(F.collect_list(F.struct(F.round("f", 6).alias("x"), F.round("db", 6).alias("y"))))
    each = curves.groupBy("signal_id", "kind").agg(points.alias("p"))
    named = each.select("signal_id", "kind", F.struct(
        F.lit("MagnitudeData").alias("_type"), F.col("signal_id").cast("string").alias("name"), F.col("kind").alias("description"),
        F.col("p")["x"].alias("x"), F.col("p")["y"].alias("y"),
    ).alias("c"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.to_json("c")))
    data = named.groupBy("signal_id").agg(pick("avg").alias("avg"), pick("peak").alias("peak"), pick("median").alias("median"))
    full = signals.join(data, "signal_id")
    member = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":'), c))
    quoted = _quoted
    curves_text = F.concat(F.lit("{"), F.concat_ws(",", *[member(k, F.col(k)) for k in ("avg", "peak", "median")]), F.lit("}"))
    slaves = F.when(F.size("slave_names") > 0, F.to_json("slave_names"))
    body = F.concat_ws(
        ",", F.lit('"_type":"SingleChannelSignalData"'), member("name", quoted(F.col("signal_id").cast("string"))),
        member("fs", F.col("fs").cast("string")), member("data", curves_text), member("offset", quoted(general(F.col("offset_db")))),
        member("filter", F.col("filter_json")), member("master_name", quoted(F.col("master_name"))), member("slave_names", slaves),
        *[member(n, _quoted(F.col(n))) for n in TIMES if n in signals.columns],
        *([member("metadata", F.to_json("metadata"))] if "metadata" in signals.columns else []),
    )
    return full.select("signal_id", F.concat(F.lit("{"), body, F.lit("}")).alias("content"))


def group_json(groups: DataFrame, channels: DataFrame) -> DataFrame:
    """(group_id, content): a bass-managed group with its channels in ``seq`` order.

    ``groups`` has (group_id, name, lpf_fs, lpf_position, headroom_type, clip_before, clip_after, offset_db);
    ``channels`` has (group_id, seq, content), as ``signal_json`` makes them. A group is one project's channels.
    """
    inner = channels.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "content")))["content"], ",").alias("_c"))
    bm = F.to_json(F.struct("lpf_fs", "lpf_position", "headroom_type"))
    clip = F.to_json(F.struct(F.col("clip_before").alias("before"), F.col("clip_after").alias("after")))
    body = F.concat(
        F.lit('{"_type":"BassManagedSignalData","name":'), _quoted(F.col("name")), F.lit(',"channels":['), F.coalesce("_c", F.lit("")),
        F.lit('],"bm":'), bm, F.lit(',"clip":'), clip, F.lit(',"offset":"'), general(F.col("offset_db")), F.lit('"}'),
    )
    return groups.join(inner, "group_id", "left").select("group_id", body.alias("content"))


def write_projects(documents: DataFrame, path: str, project: Column, order: list[str], extension: str = ".beq") -> None:
    """A gzip file for each ``project``: the JSON array of its documents' ``content``."""
    write_files(documents, path, project, F.col("content"), order, head="[", between=",", tail="]", extension=extension, compression="gzip")
