"""JSON and XML documents: catalogue, projects, filters, optimiser exports, probes,
device settings. Parsers take (path, content); readers list the files first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide import schemas
from lowtide.functions.text import general
from lowtide.sources.json_split import RANGE_BYTES, gzip_elements, json_elements

# Document names of the filter kinds.
KIND_OF = {
    "Passthrough": "Passthrough", "Gain": "Gain", "PeakingEQ": "PeakingEQ", "LowShelf": "LowShelf",
    "HighShelf": "HighShelf", "FirstOrder_LowPass": "LowPass1", "FirstOrder_HighPass": "HighPass1",
    "SecondOrder_LowPass": "LowPass2", "SecondOrder_HighPass": "HighPass2", "AllPass": "AllPass",
    "LinkwitzTransform": "LinkwitzTransform", "ComplexLowPass": "ComplexLowPass", "ComplexHighPass": "ComplexHighPass",
}
OPTIMISER_KIND = {
    "Delay": "Delay", "PeakingEQ": "PeakingEQ", "LF_ShelfVarQ": "LowShelf", "HF_ShelfVarQ": "HighShelf",
    "APF_VarQ": "AllPass", "Gain": "Gain", "PolarityInversion": "Polarity", "ComplexLowPass": "ComplexLowPass",
    "ComplexHighPass": "ComplexHighPass", "LPF_VarQ": "LowPass2", "HPF_VarQ": "HighPass2",
    "LinkwitzTransform": "LinkwitzTransform",
}
DEFAULT_DURATION = 60 * 60 * 1e6  # one hour in microseconds


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def parse_catalogue(files: DataFrame) -> DataFrame:
    """Entries of small catalogue arrays, one a row; see ``parse_entries``."""
    return parse_entries(files.select(F.posexplode(F.from_json("content", schemas.CATALOGUE)).alias("at", "e")))


def parse_entries(entries: DataFrame) -> DataFrame:
    """Catalogue entries of (at, e); ``idx`` is the place in the array. Missing fields
    get their defaults, unreadable numbers become 0."""
    rows = entries.select(F.col("at").alias("_at"), "e")
    words = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(""))
    lists = lambda c: F.coalesce(F.col(f"e.{c}"), F.array().cast("array<string>"))
    whole = lambda c: F.coalesce(F.col(f"e.{c}").try_cast("int"), F.lit(0))
    plain = {
        "title": "title", "author": "author", "season": "season", "episode": "episode", "avs": "avs",
        "sort_title": "sortTitle", "edition": "edition", "note": "note", "language": "language", "source": "source",
        "overview": "overview", "the_movie_db": "theMovieDB", "rating": "rating", "alt_title": "altTitle", "digest": "digest",
    }
    return rows.select(
        F.col("_at").cast("string").alias("idx"), *[words(c).alias(n) for n, c in plain.items()],
        whole("year").alias("year"), whole("runtime").alias("runtime"),
        F.coalesce(F.col("e.mv").try_cast("double"), F.lit(0.0)).alias("mv_adjust"),
        F.coalesce("e.content_type", F.lit("film")).alias("content_type"),
        F.coalesce("e.catalogue_url", "e.beqcUrl", F.lit("")).alias("catalogue_url"),
        lists("audioTypes").alias("audio_types"), lists("images").alias("images"), lists("warning").alias("warning"),
        lists("genres").alias("genres"), F.coalesce("e.created_at", F.lit(0)).alias("created_at"),
        F.coalesce("e.updated_at", F.lit(0)).alias("updated_at"),
        F.coalesce("e.collection.name", F.lit("")).alias("collection_name"),
        F.coalesce("e.filters", F.array().cast("array<struct<type:string,freq:double,gain:double,q:double>>")).alias("filters"),
    )


def read_catalogue(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries of catalogue files of any size: each array is read in byte ranges by many tasks."""
    entry = schemas.CATALOGUE.strip().removeprefix("array<").removesuffix(">")
    return parse_entries(json_elements(spark, path, range_bytes).select("at", F.from_json("content", entry).alias("e")).where("e IS NOT NULL"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, content): the top-level signals of gzip documents whatever their extension, each as soon as it is
    inflated."""
    return gzip_elements(spark, path)


def project_signals(files: DataFrame) -> DataFrame:
    """One row per signal of a project or of a single-signal document; the channels of
    a bass-managed group carry its settings."""
    as_list = F.when(F.ltrim("content").startswith("["), F.col("content")).otherwise(
        F.concat(F.lit("["), F.col("content"), F.lit("]"))
    )
    tops = files.select("path", F.explode(F.from_json(as_list, schemas.PROJECT)).alias("s"))
    group = F.col("s.channels").isNotNull()
    names = ["_type", "name", "fs", "data", "filter", "master_name", "slave_names", "duration_seconds", "start_seconds",
             "duration_hhmmss", "start_hhmmss", "offset", "metadata"]
    own = F.array(F.struct(*[F.col(f"s.{n}") for n in names]))
    each = tops.select(
        "path", F.when(group, F.col("s.name")).alias("group_name"), F.col("s.bm").alias("bm"), F.col("s.clip").alias("clip"),
        F.explode(F.when(group, F.col("s.channels")).otherwise(own)).alias("c"),
    )
    hms = lambda c: F.aggregate(F.split(c, ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))
    return each.select(
        "path", "group_name", "bm", "clip", F.col("c.name").alias("name"), F.col("c.fs").alias("fs"),
        F.coalesce(F.col("c.offset").try_cast("double"), F.lit(0.0)).alias("offset_db"),
        F.coalesce(F.col("c.duration_seconds").try_cast("double"), hms(F.col("c.duration_hhmmss"))).alias("duration_s"),
        F.coalesce(F.col("c.start_seconds").try_cast("double"), hms(F.col("c.start_hhmmss"))).alias("start_s"),
        F.col("c.data").alias("data"), F.col("c.filter").alias("filter"), F.col("c.master_name").alias("master_name"),
        F.coalesce(F.col("c.slave_names"), F.array().cast("array<string>")).alias("slave_names"), F.col("c.metadata").alias("metadata"),
    )


def curve_points(signals: DataFrame) -> DataFrame:
    """(path, name, kind, f, db); x is an array or an equally spaced range."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"data.{k}").alias("c")) for k in ("avg", "peak", "median")])
    rows = signals.select("path", "name", F.explode(kinds).alias("k")).where(F.col("k.c.y").isNotNull())
    listed = F.from_json("k.c.x", "array<double>")
    span = F.from_json("k.c.x", "struct<min:double, max:double, count:int>")
    ranged = F.transform(
        F.sequence(F.lit(0), span["count"] - 1),
        lambda j: span["min"] + (span["max"] - span["min"]) * j / F.greatest(span["count"] - 1, F.lit(1)),
    )
    x = F.when(F.ltrim("k.c.x").startswith("["), listed).otherwise(ranged)
    zipped = F.arrays_zip(x.alias("f"), F.col("k.c.y").alias("db"))
    return rows.select("path", "name", F.col("k.kind").alias("kind"), F.explode(zipped).alias("p")).select(
        "path", "name", "kind", "p.f", "p.db"
    )


def project_links(signals: DataFrame) -> DataFrame:
    """(path, master, slave) named in the document and present in it."""
    said = signals.select("path", F.col("name").alias("master"), F.explode("slave_names").alias("slave"))
    return said.join(signals.select("path", F.col("name").alias("slave")), ["path", "slave"], "left_semi").select("path", "master", "slave")


def filter_rows(documents: DataFrame, content: str = "content") -> DataFrame:
    """(keys..., seq, kind, fs, freq, q, gain, n, family, order, f0, q0, fp, qp) of filter
    documents; a complete filter gives its parts. Kind is null if the type is unknown."""
    kept = [c for c in documents.columns if c != content]
    parsed = documents.select(*kept, F.from_json(content, schemas.FILTER).alias("d"))
    names = ["_type", "fs", "fc", "q", "gain", "count", "order", "filter_type", "f0", "q0", "fp", "qp"]
    own = F.array(F.struct(*[F.col(f"d.{n}") for n in names]))
    inner = F.transform("d.filters", lambda x: F.struct(*[
        (F.coalesce(x[n], F.col("d.fs")) if n == "fs" else x[n]).alias(n) for n in names
    ]))
    many = F.when(F.col("d._type") == "CompleteFilter", inner).otherwise(own)
    rows = parsed.select(*kept, F.posexplode(many).alias("seq", "x"))
    return rows.select(
        *kept, F.col("seq").cast("long").alias("seq"), F.col("x._type").alias("type"),
        _lookup(F.col("x._type"), KIND_OF).alias("kind"), F.coalesce("x.fs", F.lit(1000)).alias("fs"), F.col("x.fc").alias("freq"),
        F.col("x.q").alias("q"), F.col("x.gain").alias("gain"), F.coalesce("x.count", F.lit(1)).alias("n"),
        F.col("x.filter_type").alias("family"), F.col("x.order").alias("order"),
        F.col("x.f0").alias("f0"), F.col("x.q0").alias("q0"), F.col("x.fp").alias("fp"), F.col("x.qp").alias("qp"),
    )


def optimiser_rows(files: DataFrame) -> DataFrame:
    """One row per filter of a room optimiser export: kind, channels and values as
    12-digit text. Kind is null for an unknown type."""
    rows = files.select("path", F.posexplode(F.from_json("content", schemas.OPTIMISER)["mso_filters"]).alias("seq", "x"))
    show = lambda c: general(c, 12)
    family = F.when(F.col("x.filter_type").isin("BW", "LR"), F.col("x.filter_type")).when(F.col("x.filter_type").isNotNull(), "BESM3")
    return rows.select(
        "path", "seq", F.col("x._type").alias("type"), _lookup(F.col("x._type"), OPTIMISER_KIND).alias("kind"),
        F.col("x.chans").alias("channels"), show(F.col("x.delay_val")).alias("delay"),
        show(F.coalesce("x.gain", "x.gain_val")).alias("gain"), show(F.col("x.fc")).alias("frequency"),
        show(F.col("x.q")).alias("q"), family.alias("family"), F.col("x.order").alias("order"),
        F.col("x.f0").alias("f0"), F.col("x.q0").alias("q0"), F.col("x.fp").alias("fp"), F.col("x.qp").alias("qp"),
    )


def per_channel(rows: DataFrame) -> DataFrame:
    return rows.withColumn("channel", F.explode("channels")).drop("channels")


def _hms_micros(text: Column) -> Column:
    """Microseconds of H:MM:SS.f with at most six decimals; null if not of that form."""
    part = F.split(text, ":")
    ok = text.rlike(r"^\d+:\d{1,2}:\d{1,2}\.\d+$")
    seconds = F.get(part, F.lit(2))
    cut = F.concat(F.substring_index(seconds, ".", 1), F.lit("."), F.substring(F.substring_index(seconds, ".", -1), 1, 6))
    total = (F.get(part, F.lit(0)).try_cast("double") * 3600 + F.get(part, F.lit(1)).try_cast("double") * 60 + cut.try_cast("double")) * 1e6
    return F.when(ok, F.round(total))


def probe_streams(files: DataFrame) -> DataFrame:
    """(path, index, codec_type, text, duration_us): a readable line per audio or video
    stream. Duration falls back from file to stream to tag, then to a default."""
    from lowtide.operators.stats import hms

    p = files.select("path", F.from_json("content", schemas.PROBE).alias("p"))
    rows = p.select("path", F.col("p.format.duration").alias("_whole"), F.explode("p.streams").alias("s"))
    given = F.coalesce("_whole", "s.duration").try_cast("double")
    shown = F.when(given.isNotNull(), hms(given)).otherwise(F.col("s.tags.DURATION"))
    micros = F.when(given.isNotNull(), F.round(given * 1e6)).otherwise(F.coalesce(_hms_micros(F.col("s.tags.DURATION")), F.lit(DEFAULT_DURATION)))
    codec = F.when((F.col("s.codec_name") == "dts") & F.col("s.profile").isNotNull(), F.col("s.profile")).otherwise(F.col("s.codec_long_name"))
    audio = F.concat(
        F.col("s.index").cast("string"), F.lit(": "), codec, F.lit(" - "),
        F.coalesce(F.concat("s.tags.language", F.lit(" - ")), F.lit("")), F.col("s.sample_rate"), F.lit("Hz"),
        F.coalesce(
            F.concat(F.lit(" "), "s.channel_layout", F.lit(" ")),
            F.concat(F.lit(" "), F.col("s.channels").cast("string"), F.lit(" channels ")), F.lit(""),
        ),
        F.coalesce(F.concat(F.lit(" - "), shown), F.lit("")),
    )
    video = F.concat(
        F.col("s.index").cast("string"), F.lit(": "), F.col("s.codec_name"),
        F.coalesce(F.concat(F.lit(" ("), F.col("s.width").cast("string"), F.lit("x"), F.col("s.height").cast("string"), F.lit(")")), F.lit("")),
    )
    return rows.where(F.col("s.codec_type").isin("audio", "video")).select(
        "path", F.col("s.index").alias("index"), F.col("s.codec_type").alias("codec_type"),
        F.when(F.col("s.codec_type") == "audio", audio).otherwise(video).alias("text"), micros.alias("duration_us"),
    )


def device_filters(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filters and rejected files of device settings (path, content).

    Items named PEQ_channel_slot count unless bypassed or without boost. Inputs 1
    and 2 must agree and are taken once; one other channel alone is accepted.
    Equal filters are counted: shelves carry the count, peaks repeat.
    """
    doc = F.from_xml(F.col("content"), schemas.DEVICE_XML)
    items = files.select("path", F.explode(doc["filter"]).alias("x")).withColumn("_t", F.split("x._name", "_"))
    items = items.where((F.size("_t") == 3) & (F.col("_t")[0] == "PEQ")).select(
        "path", F.col("_t")[1].alias("channel"), F.col("_t")[2].alias("slot"), "x.type", "x.freq", "x.q", "x.boost", "x.bypass",
    )
    live = ~(F.coalesce(F.col("bypass") == "1", F.lit(False)) | F.coalesce(F.col("boost") == "0", F.lit(False)))
    body = F.struct("slot", "type", "freq", "q", "boost", "bypass")
    per = items.groupBy("path", "channel").agg(
        F.array_sort(F.collect_list(F.when(live, body))).alias("set")  # at most the slots of a device
    )
    pair = lambda c: F.max(F.when(F.col("channel") == c, F.col("set")))
    chosen = per.groupBy("path").agg(
        pair("1").alias("one"), pair("2").alias("two"), F.count(F.lit(1)).alias("n"), F.first("set").alias("any")
    )
    status = (
        F.when(F.col("one").isNotNull() & F.col("two").isNotNull(), F.when(F.col("one") == F.col("two"), "ok").otherwise("inputs differ"))
        .when(F.col("one").isNotNull() | F.col("two").isNotNull(), "ok")
        .when(F.col("n") == 1, "ok").otherwise("several channels")
    )
    judged = chosen.withColumn("status", status)
    rows = judged.where("status = 'ok'").select("path", F.explode(F.coalesce("one", "two", "any")).alias("x"))
    same = rows.groupBy("path", "x.type", "x.freq", "x.q", "x.boost").agg(F.count(F.lit(1)).alias("_c"))
    kind = F.when(F.col("type") == "SL", "LowShelf").when(F.col("type") == "SH", "HighShelf").when(F.col("type") == "PK", "PeakingEQ")
    repeat = F.when(F.col("type") == "PK", F.col("_c")).otherwise(F.lit(1))
    found = same.withColumn("kind", kind).where(F.col("kind").isNotNull())
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), repeat)))
    filters = found.select(
        "path", "kind", F.col("freq").try_cast("double").alias("freq"), F.col("q").try_cast("double").alias("q"),
        F.col("boost").try_cast("double").alias("gain"), F.when(F.col("type") == "PK", 1).otherwise(F.col("_c")).cast("int").alias("n"), "copy",
    )
    return filters, judged.where("status <> 'ok'").select("path", "status")
