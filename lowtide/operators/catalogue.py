"""Operators on a catalogue of published filter sets.

Entries carry (idx, title, author, year, content_type, audio_types, ...) and,
where filters are used, ``filters`` as an array of (type, freq, gain, q).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.functions import text
from lowtide.operators import filters as O
from lowtide.operators.ordering import with_position

# Fixed values.
FRESH_SECONDS = 14 * 24 * 60 * 60
KINDS = ("PeakingEQ", "LowShelf", "HighShelf")
OPTIONAL = {
    "beqcUrl": "catalogue_url", "images": "images", "warning": "warning", "season": "season", "episodes": "episode",
    "mvAdjust": "mv_adjust", "avsUrl": "avs", "edition": "edition", "note": "note", "language": "language",
    "source": "source", "overview": "overview", "theMovieDB": "the_movie_db", "rating": "rating", "runtime": "runtime",
    "genres": "genres", "altTitle": "alt_title", "collection": "collection_name",
}


def search(
    entries: DataFrame, years: Sequence[int] = (), content_types: Sequence[str] = (), title: str = "",
    authors: Sequence[str] = (),
) -> DataFrame:
    """All given conditions; an empty one does not filter."""
    out = entries
    if years:
        out = out.where(F.col("year").isin(*years))
    if content_types:
        out = out.where(F.col("content_type").isin(*content_types))
    if title.strip():
        out = out.where(F.lower("title").contains(title.strip().casefold()))
    if authors:
        out = out.where(F.col("author").isin(*authors))
    return out


def label(entries: DataFrame, title: Column | None = None) -> Column:
    shown = F.col("formatted_title") if title is None else title
    audio = F.when(F.size("audio_types") > 0, F.concat(F.lit(" ("), F.array_join("audio_types", ","), F.lit(")"))).otherwise("")
    return F.concat(shown, F.lit(" ("), F.col("author"), F.lit(")"), audio)


def matches(entries: DataFrame, authors=(), years=(), audio_types=(), content_types=()) -> DataFrame:
    out = search(entries, years, content_types, "", authors)
    if audio_types:
        out = out.where(F.arrays_overlap("audio_types", F.array(*[F.lit(a) for a in audio_types])))
    return out


def year_range(entries: DataFrame, first: int, last: int) -> DataFrame:
    return entries.where(F.col("year").between(first, last))


def facets(entries: DataFrame) -> DataFrame:
    """(facet, value, entries) for year and content type, plus the totals."""
    years = entries.groupBy(F.lit("year").alias("facet"), F.col("year").cast("string").alias("value")).count()
    types = entries.groupBy(F.lit("content_type").alias("facet"), F.col("content_type").alias("value")).count()
    whole = entries.agg(F.min("year").alias("a"), F.max("year").alias("b"), F.count(F.lit(1)).alias("n"))
    ends = whole.select(F.explode(F.array(
        F.struct(F.lit("min_year").alias("facet"), F.col("a").cast("string").alias("value"), F.col("n").alias("count")),
        F.struct(F.lit("max_year").alias("facet"), F.col("b").cast("string").alias("value"), F.col("n").alias("count")),
    )).alias("_s")).select("_s.*")
    return years.unionByName(types).unionByName(ends).withColumnRenamed("count", "entries")


def years_descending(entries: DataFrame) -> DataFrame:
    return entries.select("year").distinct().orderBy(F.desc("year"))


def content_types(entries: DataFrame, part: str = "") -> DataFrame:
    """Sorted content types that contain a text, without regard to case."""
    kinds = entries.select("content_type").distinct()
    return kinds.where(F.lower("content_type").contains(part.casefold())).orderBy("content_type")


def lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    return entries.join(wanted.select("idx"), "idx")


def freshness(as_of: int) -> Column:
    """Fresh, Updated or Stale against an explicit time, so a rerun gives the same."""
    since = as_of - FRESH_SECONDS
    return F.when(F.col("created_at") >= since, "Fresh").when(F.col("updated_at") >= since, "Updated").otherwise("Stale")


def episode_runs(episodes: Column) -> Column:
    """``1,2,3,5`` to ``E1-3, 5``; text that is not all numbers is kept."""
    numbers = F.transform(F.split(episodes, ","), lambda e: F.trim(e).try_cast("int"))
    run = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")
    )

    def step(acc: Column, x: Column) -> Column:
        goes_on = F.coalesce(x == acc["b"] + 1, F.lit(False))
        flushed = F.when(acc["a"].isNull() | goes_on, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(run(acc["a"], acc["b"])))
        )
        return F.struct(flushed.alias("done"), F.when(goes_on, acc["a"]).otherwise(x).alias("a"), x.alias("b"))

    def finish(acc: Column) -> Column:
        return F.array_join(F.concat(acc["done"], F.array(run(acc["a"], acc["b"]))), ", ")

    joined = F.aggregate(numbers, start, step, finish)
    bad = F.exists(numbers, lambda n: n.isNull())
    return F.concat(F.lit("E"), F.when(bad, episodes).otherwise(joined))


def formatted_title(title: Column, content_type: Column, season: Column, episodes: Column) -> Column:
    blank = lambda c: c.isNull() | (c == "")
    s = F.when(blank(season), "").otherwise(F.concat(F.lit("S"), season))
    e = F.when(blank(episodes), "").otherwise(episode_runs(episodes))
    return F.when(content_type == "TV", F.concat(title, F.lit(" "), s, e)).otherwise(title)


def expand_filters(entries: DataFrame) -> DataFrame:
    """One filter row per catalogue filter; see ``unknown_filters`` for the others."""
    rows = entries.select(F.col("idx").alias(O.SET), F.posexplode("filters").alias("seq", "_f"))
    return rows.where(F.col("_f.type").isin(*KINDS)).select(
        O.SET, F.col("seq").cast("long").alias("seq"), F.col("_f.type").alias("kind"), "_f.freq", "_f.q", "_f.gain",
        F.lit(1).alias("n"),
    )


def unknown_filters(entries: DataFrame) -> DataFrame:
    rows = entries.select("idx", F.posexplode("filters").alias("seq", "_f"))
    return rows.where(~F.col("_f.type").isin(*KINDS) | F.col("_f.type").isNull()).select("idx", "seq", F.col("_f.type").alias("type"))


def responses(entries: DataFrame, points: int, fs: int = 1000, level_db: float = 0.0) -> DataFrame:
    """(filter_set_id, k, f, db): the response of every entry that has filters."""
    rows = expand_filters(entries).withColumn("fs", F.lit(fs))
    return O.response(rows, points).select(O.SET, "k", "f", (F.col("db") + level_db).alias("db"))


def search_json(entries: DataFrame) -> Column:
    """Search document: the fixed fields, and the optional ones that are not empty."""
    have = set(entries.columns)
    kinds = dict(entries.dtypes)

    def sparse(name: str) -> Column:
        c = F.col(name)
        if kinds[name].startswith("array"):
            return F.when(F.size(c) > 0, c)
        if kinds[name] == "string":
            return F.nullif(c, F.lit(""))
        return F.when(c != 0, c)

    fixed = {
        "id": "idx", "title": "title", "year": "year", "sortTitle": "sort_title", "audioTypes": "audio_types",
        "contentType": "content_type", "author": "author", "created_at": "created_at", "updated_at": "updated_at",
        "freshness": "freshness", "digest": "digest", "formattedTitle": "formatted_title",
    }
    columns = [F.coalesce(F.col(c), F.lit("")).alias(n) if kinds.get(c) == "string" else F.col(c).alias(n) for n, c in fixed.items() if c in have]
    columns += [sparse(c).alias(n) for n, c in OPTIONAL.items() if c in have]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def output_paths(entries: DataFrame, extension: str) -> DataFrame:
    """(idx, author, path, problem): one file per entry.

    Entries of one author that share a name are told apart by the first of source,
    MV, note and language that is different for all of them; otherwise by number,
    which is reported as a duplicate. Only those are numbered.
    """
    part = lambda c: F.when(F.trim(c) != "", F.concat(F.lit("_"), F.trim(c))).otherwise("")
    name = F.concat(
        F.col("formatted_title"), part(F.coalesce(F.col("edition"), F.lit(""))),
        F.when(F.col("year") != 0, F.concat(F.lit("_"), F.col("year").cast("string"))).otherwise(""),
        F.when(F.size("audio_types") > 0, F.concat(F.lit("_"), F.array_join("audio_types", "_"))).otherwise(""),
    )
    named = entries.withColumn("_name", F.regexp_replace(F.translate(name, "/", "_"), r"\.", ""))
    by = ["author", "_name"]
    counted = named.join(named.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    # Only entries that share a name are told apart: the distinct counts see no others.
    groups = counted.where("_n > 1").groupBy(*by).agg(
        *[F.count_distinct(c).alias(f"_u_{c}") for c in ("source", "mv_adjust", "note", "language")]
    )
    both = counted.join(groups, by, "left")
    unique = lambda c: F.col(f"_u_{c}") == F.col("_n")
    suffix = (
        F.when(unique("source"), F.col("source"))
        .when(unique("mv_adjust"), F.concat(F.lit("MV "), F.col("mv_adjust").cast("string")))
        .when(unique("note"), F.col("note"))
        .when(unique("language"), F.col("language"))
    )
    folder = F.concat_ws("/", F.col("content_type"), F.col("author"), F.upper(F.substring("formatted_title", 1, 1)))
    safe = lambda c: F.regexp_replace(c, r'[\\:*?"<>|]', "")
    file = lambda tail: F.concat(folder, F.lit("/"), safe(F.concat(F.col("_name"), tail)), F.lit(extension))
    told = F.when(F.col("_n") > 1, F.concat(F.lit("_"), suffix)).otherwise("")
    clear = both.where((F.col("_n") == 1) | suffix.isNotNull()).select(
        "idx", "author", file(told).alias("path"), F.lit(None).cast("string").alias("problem")
    )
    rest = both.where((F.col("_n") > 1) & suffix.isNull()).withColumn("_key", F.col("idx").cast("long"))
    rest = with_position(rest.select("idx", "_key", "formatted_title", "content_type", *by), by, ["_key"], "_at")
    numbered = rest.select(
        "idx", "author", file(F.concat(F.lit("_"), F.col("_at").cast("string"))).alias("path"),
        F.lit("Duplicate entry").alias("problem"),
    )
    return clear.unionByName(numbered)


def last_updated(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return entries.groupBy(*by).agg(F.max("updated_at").alias("last_updated"))


def publish_status(entries: DataFrame, slots: int, optimise: bool = True) -> DataFrame:
    """(idx, status, excess): failed with an unknown filter; with more filters than slots, ``excess`` of them, optimised
    if shelves may be merged to fit and failed if not; else ok."""
    n = F.size(F.filter("filters", lambda f: f["type"].isin(*KINDS)))
    bad = F.exists("filters", lambda f: ~F.coalesce(f["type"].isin(*KINDS), F.lit(False)))
    many = "optimised" if optimise else "failed"
    status = F.when(bad, "failed").when(n > slots, many).otherwise("ok")
    return entries.select("idx", status.alias("status"), F.when(~bad & (n > slots), n - slots).alias("excess"))


def status_report(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("entries"))


def publish_name(entries: DataFrame) -> Column:
    wrap = lambda c, lead="": F.when(c != "", F.concat(F.lit(f" ({lead}"), c, F.lit(")"))).otherwise("")
    gain = F.format_string("%.1f", F.col("offset_db"))
    shown = F.when(
        F.abs("offset_db") > 1e-9, F.concat(F.lit(" ("), text.signed(F.col("offset_db"), gain), F.lit(" gain)"))
    ).otherwise("")
    first = F.when(F.size("audio_types") > 0, F.concat(F.lit(" BEQ "), F.get("audio_types", F.lit(0)))).otherwise("")
    name = F.concat(
        F.col("title"), wrap(F.col("year").cast("string")), wrap(F.col("season"), "Season "), wrap(F.col("edition")),
        F.when(F.col("source") != "Disc", F.concat(F.lit(" ("), F.col("source"), F.lit(")"))).otherwise(""), shown, first,
    )
    return F.translate(name, ":", "-")


def sort_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(title)), "^the ", "")


def completeness(entries: DataFrame) -> DataFrame:
    out = entries.select(
        "idx", (F.length("title") > 0).alias("title_ok"), (F.coalesce(F.col("year"), F.lit(0)) != 0).alias("year_ok"),
        (F.size("audio_types") > 0).alias("audio_ok"),
    )
    return out.withColumn("ok", F.col("title_ok") & F.col("year_ok") & F.col("audio_ok"))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "digest") -> DataFrame:
    """Newer of both per key, by ``updated_at``: only incoming rows that are newer
    replace or join the current ones."""
    best = incoming.groupBy(key).agg(F.max_by(F.struct(*incoming.columns), F.struct("updated_at", *[c for c in ("idx",) if c in incoming.columns])).alias("_r"))
    fresh = best.select("_r.*")
    known = current.select(key, F.col("updated_at").alias("_had"))
    newer = fresh.join(known, key, "left").where(F.col("_had").isNull() | (F.col("updated_at") > F.col("_had"))).drop("_had")
    kept = current.join(newer.select(key), key, "left_anti")
    return kept.unionByName(newer.select(*current.columns))
