"""Filter-parameter operators: tables of filters to coefficients, responses,
reports and device rows.

A filter row is (filter_set_id, seq, kind, fs, freq, q, gain, n) with ``n`` the
number of stacked copies; ``seq`` is the dense position in its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowtide.functions import biquad, text
from lowtide.functions.tables import DEVICE_SLOTS, MAX_PASS_ORDER, bessel_table
from lowtide.operators.ordering import running_sum

SET = "filter_set_id"

# Short names used in reports, sort keys and device formats.
SHORT = {
    "PeakingEQ": "PEQ", "LowShelf": "LS", "HighShelf": "HS", "LowPass1": "LPF1", "HighPass1": "HPF1",
    "LowPass2": "LPF2", "HighPass2": "HPF2", "AllPass": "APF", "Gain": "Gain", "Passthrough": "Gain",
    "LinkwitzTransform": "Linkwitz Transform",
}
TEXT_EQ = {"PeakingEQ": "PK", "LowShelf": "LSC", "HighShelf": "HSC", "AllPass": "AP"}
DEVICE_TYPE = {"PeakingEQ": 0, "LowShelf": 1, "HighShelf": 2}
PLAYER_TYPE = {
    "LowPass1": "1", "LowPass2": "1", "HighPass1": "2", "HighPass2": "2", "PeakingEQ": "3", "Gain": "4",
    "LinkwitzTransform": "8", "LowShelf": "10", "HighShelf": "11", "AllPass": "17",
}
DEVICE_PEQ_SLOTS = 16


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def short_name(kind: Column) -> Column:
    return _lookup(kind, SHORT)


def with_sections(filters: DataFrame, fs: Column | None = None) -> DataFrame:
    """Add ``sos``, the section of each row, at the row's rate or at ``fs``."""
    rate = F.col("fs") if fs is None else fs
    c = lambda name: F.col(name) if name in filters.columns else F.lit(None).cast("double")
    pair = [F.col(n) for n in ("f0", "q0", "fp", "qp")] if "f0" in filters.columns else []
    return filters.withColumn("sos", biquad.coefficients(F.col("kind"), rate, c("freq"), c("q"), c("gain"), *pair))


def resample(filters: DataFrame, fs: int) -> DataFrame:
    """The same filters designed at another rate; coefficients use the stored
    (two-decimal) frequency."""
    out = filters.withColumn("fs", F.lit(fs))
    return with_sections(out.withColumn("freq", F.round("freq", 2)) if "freq" in filters.columns else out)


def unroll(filters: DataFrame) -> DataFrame:
    """One row per biquad: stacked shelves repeat ``n`` times."""
    copies = F.when(F.col("kind").isin("LowShelf", "HighShelf"), F.col("n")).otherwise(F.lit(1))
    return filters.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))


def copies() -> Column:
    return F.when(F.col("kind").isin("LowShelf", "HighShelf"), F.col("n")).otherwise(F.lit(1))


def cascades(filters: DataFrame, by: Sequence[str] = (SET,)) -> DataFrame:
    """(by..., sos): the flat coefficient list of each set in ``seq`` order. One
    cascade is what one filter pass runs, so it must fit a task."""
    rows = unroll(with_sections(filters))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "copy", "sos")))
    flat = F.flatten(F.transform(ordered, lambda r: F.array(*[r["sos"][k] for k in ("b0", "b1", "b2", "a1", "a2")])))
    return rows.groupBy(*by).agg(flat.alias("sos"))


def pass_sections(passes: DataFrame) -> DataFrame:
    """Expand (.., side low|high, family, order, fs, freq, q) to one row per biquad
    with ``sub``, ``kind`` and the section's own ``freq`` and ``q``.

    Butterworth angles are computed; a Linkwitz-Riley filter is two Butterworth
    filters of half the order; Bessel sections come from a fixed-size table. Filters that cannot be expanded are left
    out here and returned by ``rejected_passes``.
    """
    lr = F.col("family") == "LR"
    ok = (F.col("order") >= 1) & ~(lr & (F.col("order") % 2 != 0))
    rows = passes.where(ok)
    side = F.when(F.col("side") == "low", "LowPass").otherwise("HighPass")

    plain = rows.where(F.col("family").isin("BW", "LR"))
    m = F.when(lr, F.col("order") / 2).otherwise(F.col("order")).cast("int")
    plain = plain.withColumn("_m", m).withColumn("_odd", F.col("_m") % 2)
    per = F.ceil(F.col("_m") / 2).cast("int")
    total = per * F.when(lr, 2).otherwise(1)
    plain = plain.withColumn("sub", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("_s", F.col("sub") % per)
    single = (F.col("_odd") == 1) & (F.col("_s") == 0)
    step = F.lit(math.pi) / F.col("_m")
    angle = F.when(F.col("_odd") == 1, step).otherwise(step / 2.0) + (F.col("_s") - F.col("_odd")) * step
    scale = F.when(F.abs(F.col("q") - biquad.BUTTERWORTH_Q) < 1e-3, 1.0).otherwise(F.col("q") * math.sqrt(2.0))
    scale = F.when(lr & (F.col("_m") <= 2), 1.0).otherwise(scale)
    plain = plain.withColumn("kind", F.concat(side, F.when(single, "1").otherwise("2"))).withColumn(
        "q", F.when(~single, scale / (F.cos(angle) * 2.0))
    )

    bessel = F.broadcast(bessel_table(passes.sparkSession))
    curved = rows.where(F.col("family").isin("BESP", "BESM3", "BESM6")).join(bessel, ["family", "order"])
    curved = (
        curved.withColumn("sub", F.col("bseq"))
        .withColumn("kind", F.concat(side, F.when(F.col("bq").isNull(), "1").otherwise("2")))
        .withColumn("q", F.col("bq"))
        .withColumn("freq", F.when(F.col("side") == "low", F.col("freq") * F.col("bmult")).otherwise(F.col("freq") / F.col("bmult")))
    )
    columns = [*passes.columns, "sub", "kind"]
    return plain.select(*columns).unionByName(curved.select(*columns))


PASS_FAMILIES = ("BW", "LR", "BESP", "BESM3", "BESM6")


def rejected_passes(passes: DataFrame) -> DataFrame:
    """The pass filters that ``pass_sections`` cannot expand, each with the ``reason``."""
    bessel = F.col("family").startswith("BES")
    reason = (
        F.when(F.col("family").isNull() | ~F.col("family").isin(*PASS_FAMILIES), "unknown family")
        .when(F.col("order").isNull() | (F.col("order") < 1), "order below 1")
        .when((F.col("family") == "LR") & (F.col("order") % 2 != 0), "odd order")
        .when(bessel & (F.col("order") > MAX_PASS_ORDER), "order above the table")
    )
    return passes.withColumn("reason", reason).where("reason IS NOT NULL")


SECTIONS_PER_ROW = 64  # sections folded by one call; larger sets are summed by Spark
POINTS_PER_ROW = 1024


def _fold(points: int):
    """dB and phase of a few sections on one part of the grid."""

    def response(sections: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        db, phase, grids = [], [], {}
        for flat, first, last in zip(sections, low, high):
            if first not in grids:
                half = np.arange(first, last + 1) * (np.pi / points / 2.0)
                grids[first] = (np.sin(half) ** 2, np.exp(-2j * half))
            phi, z = grids[first]
            total, turn = np.zeros(len(phi)), np.zeros(len(phi))
            for b0, b1, b2, a1, a2, times in np.asarray(flat, dtype=float).reshape(-1, 6):
                num = (b0 + b1 + b2) ** 2 - 4 * phi * (b0 * b1 + 4 * b0 * b2 + b1 * b2) + 16 * phi * phi * b0 * b2
                den = (1 + a1 + a2) ** 2 - 4 * phi * (a1 + 4 * a2 + a1 * a2) + 16 * phi * phi * a2
                total += times * 10.0 * np.log10(np.maximum(num / den, 1e-300))
                turn += times * np.degrees(np.angle((b0 + z * (b1 + z * b2)) * np.conj(1 + z * (a1 + z * a2))))
            db.append(total)
            phase.append(turn)
        return pd.DataFrame({"db": db, "phase": phase})

    numbers = T.ArrayType(T.DoubleType())
    return F.pandas_udf(response, T.StructType([T.StructField("db", numbers), T.StructField("phase", numbers)])).asNondeterministic()


def response(
    filters: DataFrame, points: int, by: Sequence[str] = (SET,), tasks: int | None = None, sets: DataFrame | None = None
) -> DataFrame:
    """(by..., fs, k, f, db, phase) of each set on ``points`` frequencies from 0 to half
    the rate.

    Only sections are shuffled; the grid is made afterwards, in parts that are spread
    over ``tasks`` (by default four times the shuffle partitions, as the output is far
    larger than what is shuffled). A set of more than ``SECTIONS_PER_ROW`` sections is
    folded in pieces; the pieces of one part of the grid meet in one task, where they are summed without another
    shuffle. A set without filters has no row here: give ``sets`` (by..., fs), and those without filters pass through
    unchanged, at 0 dB.
    """
    by = list(by)
    spark = filters.sparkSession
    tasks = tasks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    terms = F.array(*[F.col("sos")[c] for c in ("b0", "b1", "b2", "a1", "a2")], copies().cast("double"))
    piece = F.floor(F.col("seq") / SECTIONS_PER_ROW) if "seq" not in by else F.lit(0)
    rows = with_sections(filters).select(
        *by, "fs", F.struct(F.col("seq").alias("at"), terms.alias("t")).alias("_r"), piece.cast("long").alias("_piece")
    )
    packed = rows.groupBy(*by, "fs", "_piece").agg(F.flatten(F.array_sort(F.collect_list("_r"))["t"]).alias("_s"))
    if sets is not None:
        bare = sets.select(*by, "fs").distinct().join(packed.select(*by, "fs"), [*by, "fs"], "left_anti")
        packed = packed.unionByName(bare.withColumns({"_piece": F.lit(0).cast("long"), "_s": F.array().cast("array<double>")}))
    starts = F.array(*[F.lit(low) for low in range(0, points, POINTS_PER_ROW)])

    parts = packed.withColumn("_low", F.explode(starts)).repartition(tasks, *by, "fs", "_low")
    high = F.least(F.col("_low") + POINTS_PER_ROW, F.lit(points)) - 1
    done = parts.select(*by, "fs", "_low", _fold(points)("_s", "_low", high).alias("_y"))
    cells = done.select(*by, "fs", "_low", F.posexplode(F.arrays_zip("_y.db", "_y.phase")).alias("_j", "_c"))
    summed = cells.groupBy(*by, "fs", "_low", "_j").agg(F.sum("_c.db").alias("db"), F.sum("_c.phase").alias("phase"))
    out = summed.select(*by, "fs", (F.col("_low") + F.col("_j")).alias("k"), "db", "phase")
    return out.withColumn("phase", biquad.wrap_degrees(F.col("phase"))).withColumn("f", F.col("k") * F.col("fs") / (2.0 * points))


def response_per_filter(filters: DataFrame, points: int, by: Sequence[str] = (SET,)) -> DataFrame:
    """The response of each set (``seq`` is null) and of each filter in it."""
    whole = response(filters, points, by).withColumn("seq", F.lit(None).cast("long"))
    return whole.unionByName(response(filters, points, [*by, "seq"]))


def dc_delay(filters: DataFrame, by: Sequence[str] = (SET,)) -> DataFrame:
    """Group delay at DC in ms, summed over the set."""
    ms = biquad.dc_delay_samples(F.col("sos")) / F.col("fs") * 1000.0 * copies()
    return with_sections(filters).groupBy(*by).agg(F.sum(ms).alias("delay_ms"))


def biquad_count(filters: DataFrame, by: Sequence[str] = (SET,)) -> DataFrame:
    return filters.groupBy(*by).agg(F.sum(copies()).alias("biquads"))


def budget(filters: DataFrame, device: str, by: Sequence[str] = (SET,)) -> DataFrame:
    """Device rows only (peaking and shelves): used, spare and missing slots."""
    slots, _ = DEVICE_SLOTS[device]
    used = biquad_count(device_filters(filters), by)
    left = F.lit(slots) - F.col("biquads")
    return used.withColumn("padding", F.greatest(left, F.lit(0))).withColumn("excess", F.greatest(-left, F.lit(0)))


def device_filters(filters: DataFrame) -> DataFrame:
    return filters.where(F.col("kind").isin("PeakingEQ", "LowShelf", "HighShelf"))


def flatten_for_device(filters: DataFrame) -> DataFrame:
    return unroll(device_filters(filters)).withColumn("n", F.lit(1))


def sort_key(kind: Column, freq: Column, gain: Column) -> Column:
    """Text that orders filters by frequency, gain and type; passthrough last."""
    f, g, name = text.padded(F.round(freq, 2)), text.padded(F.round(gain, 3)), short_name(kind)
    gained = kind.isin("PeakingEQ", "LowShelf", "HighShelf")
    return (
        F.when(kind == "Passthrough", F.lit("ZZZZZZZZZZZZZZ"))
        .when(kind == "Gain", F.concat(F.lit("00000"), g, name))
        .when(gained, F.concat(f, g, name))
        .otherwise(F.concat(f, F.lit("00000"), name))
    )


def upsert(filters: DataFrame, changes: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Replace filters with the same (set, seq), append the others, then delete."""
    kept = filters.join(changes.select(SET, "seq"), [SET, "seq"], "left_anti")
    out = kept.unionByName(changes.select(*kept.columns))
    return out if deletes is None else out.join(deletes.select(SET, "seq"), [SET, "seq"], "left_anti")


def _share_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sets in order of weight, giving each shelf its share of what is left, a half
    to the even number; where no weight is left (shelves without gain), each takes what it can.
    Rows arrive sorted, so a set of any size needs two numbers of state."""
    current, left, weight = None, 0, 0.0
    for frame in frames:
        given = []
        for row in frame.itertuples(index=False):
            if row.filter_set_id != current:
                current, left, weight = row.filter_set_id, row.to_save, row.total_weight
            share = round(round(row.weight / weight * left, 9)) if weight > 1e-9 else left
            take = min(share, row.n - 1)
            left, weight = left - take, weight - row.weight
            given.append(take)
        yield frame.assign(take=given)


def reduce_shelves(filters: DataFrame, slots: int) -> DataFrame:
    """Fit each set into ``slots`` biquads by merging stacked shelves: fewer copies
    with the same total gain and a slope between the old and the new one. Sets that
    fit, and other filters, are unchanged. ``saved`` says how many copies went."""
    used = filters.groupBy(SET).agg(F.sum(copies()).alias("_used"))
    sized = filters.join(used, SET)
    stacked = F.col("kind").isin("LowShelf", "HighShelf") & (F.col("n") > 1) & (F.col("_used") > slots)
    rest = sized.where(~stacked).withColumn("saved", F.lit(0))
    shelves = sized.where(stacked).withColumn("weight", F.abs(F.col("gain") * F.col("n")))
    totals = shelves.groupBy(SET).agg(F.sum("weight").alias("total_weight"))
    todo = shelves.join(totals, SET).withColumn("to_save", (F.col("_used") - slots).cast("long"))
    todo = todo.withColumn("_order", -F.col("gain") * F.col("n"))
    todo = todo.repartition(SET).sortWithinPartitions(SET, "_order", F.desc("n"), "seq")
    shared = todo.mapInPandas(_share_out, T.StructType(list(todo.schema.fields)).add("take", T.LongType()))
    n = F.col("n") - F.col("take")
    gain = F.col("gain") * F.col("n") / n
    slope = (biquad.shelf_slope(F.col("q"), gain) + biquad.shelf_slope(F.col("q"), F.col("gain"))) / 2.0
    changed = F.col("take") > 0
    merged = shared.select(
        *[c for c in filters.columns if c not in ("q", "gain", "n")],
        F.when(changed, biquad.shelf_q(slope, gain)).otherwise(F.col("q")).alias("q"),
        F.when(changed, gain).otherwise(F.col("gain")).alias("gain"),
        n.cast("int").alias("n"), F.col("take").cast("int").alias("saved"),
    )
    return merged.unionByName(rest.select(*merged.columns))


def device_ops(filters: DataFrame, slots: int = DEVICE_PEQ_SLOTS) -> DataFrame:
    """Replace operations (set, slot, path, value) per filter, each set padded to
    ``slots`` with neutral filters. Sets holding an unsupported kind are left out;
    see ``unsupported``."""
    bad = unsupported(filters)
    rows = filters.join(bad.select(SET), SET, "left_anti")
    neutral = rows.groupBy(SET).agg((F.max("seq") + 1).alias("_n")).where(F.col("_n") < slots)
    neutral = neutral.select(
        SET, F.explode(F.sequence(F.col("_n"), F.lit(slots - 1).cast("long"))).alias("seq"),
        F.lit("PeakingEQ").alias("kind"), F.lit(100.0).alias("freq"), F.lit(1.0).alias("q"), F.lit(0.0).alias("gain"),
    )
    rows = rows.select(SET, "seq", "kind", "freq", "q", "gain").unionByName(neutral)
    prefix = F.concat(F.lit("/peq/slots/"), F.col("seq").cast("string"), F.lit("/channels/"), F.col(SET).cast("string"))
    op = lambda name, value: F.struct(F.concat(prefix, F.lit("/" + name)).alias("path"), value.cast("double").alias("value"))
    ops = F.array(
        op("Fc", F.round("freq", 2)), op("Q", F.col("q")), op("gaindB", F.round("gain", 3)),
        op("FilterType", _lookup(F.col("kind"), DEVICE_TYPE)),
    )
    return rows.select(SET, F.col("seq").alias("slot"), F.explode(ops).alias("_o")).select(
        SET, "slot", F.lit("replace").alias("op"), "_o.path", "_o.value"
    )


def unsupported(filters: DataFrame, kinds: Sequence[str] = tuple(DEVICE_TYPE)) -> DataFrame:
    """(set, types): the kinds a device cannot hold, as a sorted set."""
    return filters.where(~F.col("kind").isin(*kinds)).groupBy(SET).agg(
        F.array_sort(F.collect_set(short_name(F.col("kind")))).alias("types")
    )


def slot_placement(filters: DataFrame, slots: int = DEVICE_PEQ_SLOTS) -> DataFrame:
    """Unrolled device filters numbered so the last one takes the last slot. In a set with more of them than slots,
    ``slot`` is null: it does not fit the device."""
    flat = device_filters(filters).withColumn("_c", copies())
    placed = running_sum(flat, [SET], "seq", F.col("_c"), "_at", inclusive=False)
    total = flat.groupBy(SET).agg(F.sum("_c").alias("_all"))
    out = unroll(placed.join(total, SET))
    slot = F.when(F.col("_all") <= slots, F.lit(slots) - F.col("_all") + F.col("_at") + F.col("copy") - 1)
    return out.select(
        SET, slot.alias("slot"), F.round("freq", 2).alias("freq"), "q", F.round("gain", 3).alias("gain"),
        _lookup(F.col("kind"), DEVICE_TYPE).alias("filter_type"),
    )


def difference(wanted: DataFrame, reported: DataFrame, keys: Sequence[str] = (SET, "seq")) -> DataFrame:
    """Status per slot: same, changed, missing on the device, or extra on it."""
    keys = list(keys)
    a = wanted.select(*keys, F.col("freq").alias("wf"), F.col("gain").alias("wg"), F.col("q").alias("wq"))
    b = reported.select(*keys, F.col("freq").alias("rf"), F.col("gain").alias("rg"), F.col("q").alias("rq"))
    close = F.abs(F.col("wq") - F.col("rq")) <= F.greatest(F.abs("wq"), F.abs("rq")) * 1e-9
    same = (F.col("wf") == F.col("rf")) & (F.col("wg") == F.col("rg")) & close
    status = (
        F.when(F.col("rf").isNull(), "missing").when(F.col("wf").isNull(), "extra")
        .when(same, "same").otherwise("changed")
    )
    return a.join(b, keys, "full_outer").withColumn("status", status)


def player_rows(filters: DataFrame, target: str, legacy_q: bool = False) -> DataFrame:
    """Filter rows as the player's operations. Pass filters must be expanded by
    ``pass_sections`` first, except those ``player_passes`` takes whole."""
    kind = F.col("kind")
    shelf = kind.isin("LowShelf", "HighShelf")
    q = F.when(shelf & F.lit(legacy_q), biquad.shelf_slope(F.col("q"), F.col("gain"))).otherwise(F.col("q"))
    one_pole, two_pole = kind.isin("LowPass1", "HighPass1"), kind.isin("LowPass2", "HighPass2")
    q_text = F.when(one_pole, "1").when(two_pole, text.general(q, 12)).when(kind != "Gain", text.general(q, 7))
    gain_text = F.when(one_pole | two_pole | (kind == "AllPass"), "0").otherwise(text.general(F.round("gain", 3), 7))
    out = filters.select(
        *[c for c in (SET, "seq", "sub") if c in filters.columns],
        F.lit("1").alias("Enabled"), _lookup(kind, PLAYER_TYPE).alias("Type"),
        F.when(one_pole, "6").when(kind != "Gain", "12").alias("Slope"),
        q_text.alias("Q"), F.when(kind != "Gain", text.general(F.round("freq", 2), 7)).alias("Frequency"),
        gain_text.alias("Gain"), F.lit(target).alias("Channels"),
    )
    return out.where(F.col("Type").isNotNull())


def player_passes(passes: DataFrame, target: str) -> DataFrame:
    """Butterworth 4, 6 and 8 stay one row (slope 6 dB per order); any other pass
    filter becomes one row per biquad."""
    whole = (F.col("family") == "BW") & F.col("order").isin(4, 6, 8)
    kept = passes.where(whole).select(
        SET, "seq", F.lit(0).alias("sub"), F.lit("1").alias("Enabled"),
        F.when(F.col("side") == "low", "1").otherwise("2").alias("Type"),
        (F.col("order") * 6).cast("string").alias("Slope"), text.general(F.col("q"), 12).alias("Q"),
        text.general(F.round("freq", 2), 7).alias("Frequency"), F.lit("0").alias("Gain"), F.lit(target).alias("Channels"),
    )
    split = pass_sections(passes.where(~whole)).withColumn("gain", F.lit(0.0))
    return player_rows(split, target).select(*kept.columns).unionByName(kept)


def _numbered(filters: DataFrame) -> DataFrame:
    """One row per biquad with its 1-based number in the set."""
    sized = filters.withColumn("_c", copies())
    placed = running_sum(sized, [SET], "seq", F.col("_c"), "_at", inclusive=False)
    return unroll(placed).withColumn("number", (F.col("_at") + F.col("copy")).cast("long")).drop("_c", "_at")


def eq_text(filters: DataFrame) -> DataFrame:
    """(set, number, line): equaliser text, shelves unrolled. Kinds the format does
    not know are left out and do not take a number."""
    known = _numbered(filters.where(F.col("kind").isin(*TEXT_EQ)))
    fc = F.concat(F.lit(" Fc "), text.general(F.round("freq", 2)), F.lit(" Hz"))
    gain = F.when(F.col("kind") == "AllPass", "").otherwise(
        F.concat(F.lit(" Gain "), text.general(F.round("gain", 3)), F.lit(" dB"))
    )
    line = F.concat(
        F.lit("Filter "), F.col("number").cast("string"), F.lit(": ON "), _lookup(F.col("kind"), TEXT_EQ), fc, gain,
        F.lit(" Q "), text.plain(F.round("q", 4)),
    )
    return known.select(SET, "number", line.alias("line"))


def biquad_report(
    filters: DataFrame, fs: int, total: int, style: str = "decimal", device: bool = False, places: int | None = None
) -> DataFrame:
    """(set, number, text): coefficients as decimal, ieee or fixed text, each set
    padded with passthrough to ``total``. ``device`` negates the a terms."""
    rows = with_sections(_numbered(filters.withColumn("fs", F.lit(fs))))
    rows = rows.select(SET, "number", "sos")
    through = biquad.flat_gain(F.lit(0.0))
    counts = filters.groupBy(SET).agg(F.sum(copies()).alias("_n")).where(F.col("_n") < total)
    pads = counts.select(
        SET, F.explode(F.sequence(F.col("_n") + 1, F.lit(total).cast("long"))).alias("number"), through.alias("sos")
    )
    show = {"decimal": text.plain if places is None else text.plain_rounded, "ieee": text.float_hex, "fixed": text.fixed_hex}[style]
    sign = -1.0 if device else 1.0

    def term(name: str) -> Column:
        v = F.col("sos")[name] * (sign if name in ("a1", "a2") else 1.0) + 0.0
        v = v if places is None else F.round(v, places) + 0.0
        return F.concat(F.lit(f"{name}="), show(v))

    names = ["b0", "b1", "b2", "a1", "a2"]
    terms = [term(n) for n in names]
    if not device:
        terms.insert(3, F.concat(F.lit("a0="), show(F.lit(1.0))))
    label = "biquad" if style == "decimal" else "hex"
    body = F.concat(F.lit(label), F.col("number").cast("string"), F.lit(",\n"), F.concat_ws(",\n", *terms))
    return rows.unionByName(pads).select(SET, "number", body.alias("text"))


def summary_table(filters: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """(set, seq, freq, gain, q, type, total) as text; a set's level offset becomes
    an extra row of type MV."""
    n = copies()
    gain = F.when(F.col("kind") == "AllPass", 0.0).otherwise(F.round("gain", 3))
    has = gain != 0
    rows = filters.select(
        SET, "seq", text.plain(F.round("freq", 2)).alias("freq"),
        F.when(has, text.signed(gain, text.general(gain))).otherwise("N/A").alias("gain"),
        text.plain(F.round("q", 4)).alias("q"),
        F.concat(short_name(F.col("kind")), F.when(n > 1, F.concat(F.lit(" x"), n.cast("string"))).otherwise("")).alias("type"),
        F.when(has & (n > 1), text.signed(gain, text.general(gain * n))).otherwise("").alias("total"),
    )
    if offsets is None:
        return rows
    mv = offsets.where(F.abs("offset_db") > 1e-9).select(
        SET, F.lit(None).cast("long").alias("seq"), F.lit("").alias("freq"),
        text.signed(F.col("offset_db"), text.general(F.col("offset_db"))).alias("gain"),
        F.lit("").alias("q"), F.lit("MV").alias("type"), F.lit("").alias("total"),
    )
    return rows.unionByName(mv)
