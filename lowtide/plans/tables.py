"""The library's tables derived from the given parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lowtide.operators import samples as S
from lowtide.operators.ordering import with_position
from lowtide.session import materialise_at

_STORED: dict[tuple, tuple[str, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table stored once per application, as a user keeps a sample table;
    it is made again if its folder has been cleared."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STORED:
        path, schema = _STORED[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass
    df, path = materialise_at(build(), name)
    _STORED[key] = (path, df.schema)
    return df


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal per user: (signal_id, user_id, i, v, fs)."""

    def build() -> DataFrame:
        events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
        placed = with_position(events, ["user_id"], ["ts", "event_id"])
        return placed.select(
            F.concat(F.lit("s"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("signal_id"),
            "user_id", "i", ((F.col("value") - 50.0) / 500.0).alias("v"), F.lit(64).alias("fs"),
        )

    return _stored(spark, sf_dir, "samples", build)


def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six channels per title: (title, ch, channel, i, v, fs), 5.1 channel order."""
    names = F.array(*[F.lit(c) for c in ("FL", "FR", "FC", "LFE", "BL", "BR")])
    ch = (F.col("user_id") % 6).cast("int")
    return samples(spark, sf_dir).select(
        (F.col("user_id") - F.col("user_id") % 6).alias("title"), ch.alias("ch"),
        F.element_at(names, ch + 1).alias("channel"), "i", "v", "fs",
    )


def sample_blocks(spark: SparkSession, sf_dir: str, block: int = 64) -> DataFrame:
    """The samples of ``samples`` as blocks with the series length: (signal_id, fs, n, block_no, start_i, samples)."""

    def build() -> DataFrame:
        rows = samples(spark, sf_dir)
        sized = rows.groupBy("signal_id", "fs").agg((F.max("i") + 1).alias("n"))
        return S.to_blocks(rows, ["signal_id"], block).join(sized, "signal_id")

    return _stored(spark, sf_dir, f"sample-blocks-{block}", build)


def long_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few long signals in blocks of 64: (signal_id, fs, n, block_no, start_i, samples)."""

    def build() -> DataFrame:
        placed = with_position(
            table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"], "block_no"
        )
        sized = placed.groupBy("label").agg(F.sum(F.size("embedding")).alias("n"))
        return placed.join(sized, "label").select(
            F.col("label").alias("signal_id"), F.lit(64).alias("fs"), F.col("n").cast("long").alias("n"), "block_no",
            (F.col("block_no") * 64).alias("start_i"), F.col("embedding").cast("array<double>").alias("samples"),
        )

    return _stored(spark, sf_dir, "long-blocks", build)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-point curve per vector, 4 Hz apart: (curve_id, k, f, db)."""
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("curve_id"), F.posexplode("embedding").alias("k", "x")
    )
    return v.select(
        "curve_id", "k", ((F.col("k") + 1) * 4.0).alias("f"), (F.col("x").cast("double") * 40.0).alias("db")
    )


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of eight filters: (filter_set_id, seq, kind, fs, freq, q, gain, n)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    kind = F.col("p_type")
    return p.select(
        F.floor(F.col("p_partkey") / 8).alias("filter_set_id"),
        (F.col("p_partkey") % 8).alias("seq"),
        F.when(kind.isin("ECONOMY", "STANDARD"), "LowShelf")
        .when(kind == "SMALL", "HighShelf")
        .when(kind.isin("MEDIUM", "LARGE"), "PeakingEQ")
        .otherwise("AllPass").alias("kind"),
        F.lit(1000).alias("fs"),
        (F.col("p_size") * 3 + 5).cast("double").alias("freq"),
        ((F.col("p_partkey") % 8 + 5) / 10.0).alias("q"),
        ((F.col("p_retailprice") - 950.0) / 10.0).alias("gain"),
        (F.col("p_partkey") % 3 + 1).cast("int").alias("n"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published entry per part, with the fields the catalogue operators use."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.cast("string").alias("idx"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        (F.col("p_size") + 1980).cast("int").alias("year"),
        F.when(key % 3 == 0, "TV").otherwise("film").alias("content_type"),
        F.array("p_type").alias("audio_types"),
        F.when(key % 4 == 0, "Disc").otherwise("Streaming").alias("source"),
        (1700000000 + key * 86400).alias("created_at"),
        (1700000000 + key * 90000).alias("updated_at"),
        F.when(key % 3 == 0, (key % 5).cast("string")).otherwise("").alias("season"),
        F.when(key % 7 == 0, F.lit("Director's Cut")).otherwise("").alias("edition"),
        F.when(key % 5 == 0, F.lit("-1.5")).otherwise("0").alias("mv"),
        F.concat(F.lit("note "), (key % 11).cast("string")).alias("note"),
        F.when(key % 2 == 0, "English").otherwise("").alias("language"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A routing matrix per order: (matrix_id, i, w, o)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return li.select(
        F.col("l_orderkey").alias("matrix_id"),
        F.col("l_linenumber").cast("int").alias("i"),
        (F.col("l_suppkey") % 2).cast("int").alias("w"),
        (F.col("l_partkey") % 8 + 1).cast("int").alias("o"),
    ).distinct()


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, ep), with gaps and repeats."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey")
    return li.select(
        F.col("l_partkey").alias("title"),
        (F.col("l_linenumber") + (F.col("l_suppkey") % 3) * 7).cast("int").alias("ep"),
    )


# The same tables for the comparison engine, as WITH clauses.
SQL = {
    "samples": """samples as (select concat('s', lpad(cast(user_id as varchar), 5, '0')) as signal_id, user_id,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i,
  (value - 50.0::double) / 500.0::double as v, cast(64 as integer) as fs from events)""",
    "channel_samples": """channel_samples as (select user_id - user_id % 6 as title, cast(user_id % 6 as integer) as ch,
  (['FL','FR','FC','LFE','BL','BR'])[user_id % 6 + 1] as channel,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i,
  (value - 50.0::double) / 500.0::double as v, cast(64 as integer) as fs from events)""",
    "long": """long_b as (select label as signal_id,
  row_number() over (partition by label order by vec_id) - 1 as block_no, embedding from embeddings),
long as (select signal_id, cast(block_no * 64 + k - 1 as bigint) as i, cast(embedding[k] as double) as v, 64 as fs
  from long_b, (select unnest(range(1, 65)) as k))""",
    "curves": """curves as (select vec_id as curve_id, cast(k - 1 as integer) as k, k * 4.0::double as f,
  cast(embedding[k] as double) * 40.0::double as db from embeddings, (select unnest(range(1, 65)) as k))""",
    "filters": """filters as (select p_partkey // 8 as filter_set_id, p_partkey % 8 as seq,
  case when p_type in ('ECONOMY','STANDARD') then 'LowShelf' when p_type = 'SMALL' then 'HighShelf'
       when p_type in ('MEDIUM','LARGE') then 'PeakingEQ' else 'AllPass' end as kind,
  cast(1000 as integer) as fs, cast(3 * p_size + 5 as double) as freq,
  cast(p_partkey % 8 + 5 as double) / 10 as q, (p_retailprice - 950.0::double) / 10.0::double as gain,
  cast(p_partkey % 3 + 1 as integer) as n from part)""",
    "catalogue": """catalogue as (select cast(p_partkey as varchar) as idx, p_name as title, p_brand as author,
  cast(p_size + 1980 as integer) as year, case when p_partkey % 3 = 0 then 'TV' else 'film' end as content_type,
  [p_type] as audio_types, case when p_partkey % 4 = 0 then 'Disc' else 'Streaming' end as source,
  1700000000 + p_partkey * 86400 as created_at, 1700000000 + p_partkey * 90000 as updated_at,
  case when p_partkey % 3 = 0 then cast(p_partkey % 5 as varchar) else '' end as season,
  case when p_partkey % 7 = 0 then 'Director''s Cut' else '' end as edition,
  case when p_partkey % 5 = 0 then '-1.5' else '0' end as mv,
  concat('note ', cast(p_partkey % 11 as varchar)) as note,
  case when p_partkey % 2 = 0 then 'English' else '' end as language from part)""",
    "routes": """routes as (select distinct l_orderkey as matrix_id, cast(l_linenumber as integer) as i,
  cast(l_suppkey % 2 as integer) as w, cast(l_partkey % 8 + 1 as integer) as o from lineitem)""",
    "episodes": """episodes as (select l_partkey as title, cast(l_linenumber + 7 * (l_suppkey % 3) as integer) as ep
  from lineitem)""",
}


def sql_with(*names: str, extra: str = "") -> str:
    parts = [SQL[n] for n in names] + ([extra] if extra else [])
    return "with recursive " + ",\n".join(parts) + "\n"
