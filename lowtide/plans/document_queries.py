"""Registered queries on documents, text exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import filters as O
from lowtide.plans.registry import query
from lowtide.plans.tables import catalogue, curves, filters, sql_with, table
from lowtide.session import shared_dir
from lowtide.sinks import exports as K
from lowtide.sinks.grouped import write_files
from lowtide.sources import documents as D
from lowtide.sources import text as X
from lowtide.sources.wav import channel_name
from lowtide.streaming import ingest as I
from lowtide.streaming import meter as V


def _curve_lines(spark, sf):
    rows = curves(spark, sf).select(F.col("curve_id").alias("signal_id"), F.lit("avg").alias("kind"), "f", "db")
    signals = table(spark, sf, "embeddings").select(F.col("vec_id").alias("signal_id"), F.lit(512).alias("fs"))
    return K.response_lines(rows, signals)


@query("response_text", sql_with("curves") + """select curve_id as signal_id, 'avg' as kind, cast(k + 3 as bigint) as line_no,
 lpad(printf('%.3f', f), 8, ' ') || ' ' || lpad(printf('%.3f', db), 8, ' ') as value from curves
 union all select vec_id, 'avg', cast(n as bigint), (['# Signal Name: ' || vec_id, '# Fs: 512', '# frequency magnitude'])[n + 1] from embeddings, (select unnest([0, 1, 2]) as n)""")
def response_text(spark, sf):
    return _curve_lines(spark, sf)


@query("parsed_response_text", sql_with("curves") + "select cast(curve_id as varchar) as name, 'avg' as kind, round(f, 3) as f, round(cast(printf('%.3f', db) as double), 3) + 0.0 as db from curves")
def parsed_response_text(spark, sf):
    lines = _curve_lines(spark, sf)
    files = lines.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "value")))["value"].alias("v")).select(
        F.concat(F.lit("/x/"), F.col("signal_id").cast("string"), F.lit("_avg.frd")).alias("path"), F.array_join("v", "\n").alias("content")
    )
    return X.parse_response(files).withColumn("db", F.col("db") + 0.0)


@query("response_rate", "select cast(vec_id as varchar) as name, cast(512 as integer) as fs from embeddings")
def response_rate(spark, sf):
    points = curves(spark, sf).select(F.col("curve_id").cast("string").alias("name"), "f", "db")
    return X.response_rates(points)


@query("parsed_equaliser_text", sql_with("filters") + """select filter_set_id, kind, round(freq, 2) as freq, round(q, 4) as q,
 case when kind <> 'AllPass' then round(gain, 3) + 0.0 end as gain, count(*) as n from (
 select *, unnest(range(case when kind in ('LowShelf', 'HighShelf') then n else 1 end)) from filters) group by all""")
def parsed_equaliser_text(spark, sf):
    lines = O.eq_text(filters(spark, sf)).select("filter_set_id", "line")
    rows = X.parse_equaliser(lines)
    return rows.groupBy("filter_set_id", "kind", "freq", "q", "gain").agg(F.count(F.lit(1)).alias("n"))


@query("filter_documents", sql_with("filters") + """select filter_set_id, seq, kind, fs, freq, case when kind <> 'AllPass' then round(gain, 3) + 0.0 end as gain, q,
 cast(case when kind in ('LowShelf', 'HighShelf') then n else 1 end as integer) as n from filters""")
def filter_documents(spark, sf):
    docs = K.filter_set_json(filters(spark, sf))
    return D.filter_rows(docs).select("filter_set_id", "seq", "kind", "fs", "freq", (F.col("gain") + 0.0).alias("gain"), "q", "n")


def _signal_documents(spark, sf):
    ids = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("signal_id"), F.lit(512).alias("fs"), F.lit(1.5).alias("offset_db"), F.lit(None).cast("string").alias("filter_json"),
        F.lit(None).cast("string").alias("master_name"), F.array().cast("array<string>").alias("slave_names"),
    )
    rows = curves(spark, sf).select(F.col("curve_id").alias("signal_id"), F.lit("avg").alias("kind"), "f", "db")
    return K.signal_json(ids, rows).select(F.col("signal_id").cast("string").alias("path"), "content")


@query("project_documents", sql_with("curves") + "select cast(curve_id as varchar) as name, 'avg' as kind, f, round(db, 6) + 0.0 as db from curves")
def project_documents(spark, sf):
    points = D.curve_points(D.project_signals(_signal_documents(spark, sf)))
    return points.select("name", "kind", "f", (F.col("db") + 0.0).alias("db"))


@query("gzip_projects", sql_with("curves") + "select cast(curve_id as varchar) as name, 'avg' as kind, f, round(db, 6) + 0.0 as db from curves")
def gzip_projects(spark, sf):
    """The same documents, 256 to a gzip project whose extension says nothing, read as they are inflated."""
    folder = f"{shared_dir(spark)}/projects-{uuid.uuid4().hex}"
    docs = _signal_documents(spark, sf).withColumn("id", F.col("path").cast("long"))
    K.write_projects(docs, folder, F.floor(F.col("id") / 256), ["id"], ".signal")
    points = D.curve_points(D.project_signals(D.read_projects(spark, folder)))
    return points.select("name", "kind", "f", (F.col("db") + 0.0).alias("db"))


@query("response_files", sql_with("curves") + "select cast(curve_id as varchar) as name, 'avg' as kind, round(f, 3) as f, round(cast(printf('%.3f', db) as double), 3) + 0.0 as db from curves where curve_id % 8 = 0")
def response_files(spark, sf):
    """Every eighth curve as a text file of its own, written with a commit and read back."""
    folder = f"{shared_dir(spark)}/responses-{uuid.uuid4().hex}"
    K.write_responses(_curve_lines(spark, sf).where("signal_id % 8 = 0"), folder)
    return X.read_response(spark, folder).withColumn("db", F.col("db") + 0.0)


# Every kind of filter that a document can hold.
DOCUMENT_KINDS = list(D.KIND_OF.values())
EVERY_KIND = f"""kinds as (select p_partkey // 8 as filter_set_id, p_partkey % 8 as seq, ({DOCUMENT_KINDS})[p_partkey % {len(DOCUMENT_KINDS)} + 1] as kind,
 cast(3 * p_size + 5 as double) / 7 as freq, cast(p_partkey % 8 + 5 as double) / 10 as q, (p_retailprice - 950.0::double) / 10.0::double as gain,
 cast(p_partkey % 3 + 1 as integer) as n from part)"""


def _every_kind(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    key, kind = F.col("p_partkey"), F.array(*[F.lit(k) for k in DOCUMENT_KINDS])
    return p.select(
        F.floor(key / 8).alias("filter_set_id"), (key % 8).alias("seq"), F.element_at(kind, (key % len(DOCUMENT_KINDS) + 1).cast("int")).alias("kind"),
        F.lit(48000).alias("fs"), ((F.col("p_size") * 3 + 5) / 7).alias("freq"), ((key % 8 + 5) / 10.0).alias("q"),
        ((F.col("p_retailprice") - 950.0) / 10.0).alias("gain"), (key % 3 + 1).cast("int").alias("n"),
        F.when(key % 2 == 0, "BW").otherwise("LR").alias("family"), (key % 4 * 2 + 2).cast("int").alias("order"),
        (F.col("p_size") + 20.5).alias("f0"), F.lit(0.7).alias("q0"), (F.col("p_size") + 10.25).alias("fp"), F.lit(0.5).alias("qp"),
    )


def _project_groups(spark, sf):
    """Two filter sets a group: a master with the other as its slave, each with all its filters and a curve."""
    rows = _every_kind(spark, sf)
    sets = K.filter_set_json(rows)
    id = F.col("filter_set_id")
    name = lambda c: F.concat(F.lit('channel "'), c.cast("string"), F.lit('"'))
    signals = sets.select(
        id.alias("signal_id"), F.lit(48000).alias("fs"), (id % 5 * 0.5).alias("offset_db"), F.col("content").alias("filter_json"),
        F.when(id % 2 == 1, (id - 1).cast("string")).alias("master_name"),
        F.when(id % 2 == 0, F.array((id + 1).cast("string"), F.lit("nowhere"))).otherwise(F.array().cast("array<string>")).alias("slave_names"),
    )
    curve = rows.select(id.alias("signal_id"), F.lit("peak").alias("kind"), (F.col("seq") + 1.0).alias("f"), F.col("gain").alias("db"))
    channels = K.signal_json(signals, curve).select(F.floor(F.col("signal_id") / 2).alias("group_id"), (F.col("signal_id") % 2).alias("seq"), "content")
    g = F.col("group_id")
    groups = channels.select("group_id").distinct().select(
        g, F.concat(F.lit('room "'), g.cast("string"), F.lit('"\n')).alias("name"), (g % 3 * 40.0 + 80).alias("lpf_fs"),
        F.when(g % 2 == 0, "Before").otherwise("After").alias("lpf_position"), F.lit("WCS").alias("headroom_type"),
        (g % 2 == 0).alias("clip_before"), (g % 3 == 0).alias("clip_after"), F.lit(0.0).alias("offset_db"),
    )
    docs = K.group_json(groups, channels)
    folder = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}"
    K.write_projects(docs, folder, F.floor(g / 64), ["group_id"])
    return D.project_signals(D.read_projects(spark, folder))


@query("project_groups", f"""with {EVERY_KIND}, s as (select distinct filter_set_id as id from kinds)
select 'room "' || id // 2 || '"' || chr(10) as group_name, cast(id as varchar) as name, cast(48000 as integer) as fs, id % 5 * 0.5::double as offset_db,
 id // 2 % 3 * 40.0::double + 80 as lpf_fs, case when id // 2 % 2 = 0 then 'Before' else 'After' end as lpf_position, 'WCS' as headroom_type,
 id // 2 % 2 = 0 as clip_before, id // 2 % 3 = 0 as clip_after, case when id % 2 = 1 then cast(id - 1 as varchar) end as master_name from s""")
def project_groups(spark, sf):
    return _project_groups(spark, sf).select(
        "group_name", "name", "fs", "offset_db", "bm.lpf_fs", "bm.lpf_position", "bm.headroom_type", F.col("clip.before").alias("clip_before"),
        F.col("clip.after").alias("clip_after"), "master_name",
    )


@query("project_links", f"""with {EVERY_KIND}, s as (select distinct filter_set_id as id from kinds)
select cast(a.id as varchar) as master, cast(b.id as varchar) as slave from s a join s b on b.id = a.id + 1 where a.id % 2 = 0""")
def project_links(spark, sf):
    return D.project_links(_project_groups(spark, sf)).select("master", "slave")


@query("project_filters", f"""with {EVERY_KIND}
select cast(filter_set_id as varchar) as name, seq, kind, cast(48000 as integer) as fs,
 case when kind like 'Complex%' then freq when kind not in ('Passthrough', 'Gain', 'LinkwitzTransform') then round(freq, 2) end as freq,
 case when kind in ('PeakingEQ', 'LowShelf', 'HighShelf', 'LowPass2', 'HighPass2', 'AllPass') then q end as q,
 case when kind in ('PeakingEQ', 'LowShelf', 'HighShelf', 'Gain') then round(gain, 3) + 0.0 end as gain,
 cast(case when kind in ('LowShelf', 'HighShelf') then n else 1 end as integer) as n,
 case when kind like 'Complex%' then case when (filter_set_id * 8 + seq) % 2 = 0 then 'BW' else 'LR' end end as family,
 cast(case when kind like 'Complex%' then (filter_set_id * 8 + seq) % 4 * 2 + 2 end as integer) as "order",
 case when kind = 'LinkwitzTransform' then (freq * 7 - 5) / 3 + 20.5 end as f0, case when kind = 'LinkwitzTransform' then 0.7::double end as q0,
 case when kind = 'LinkwitzTransform' then (freq * 7 - 5) / 3 + 10.25 end as fp, case when kind = 'LinkwitzTransform' then 0.5::double end as qp from kinds""")
def project_filters(spark, sf):
    signals = _project_groups(spark, sf).select("name", F.to_json("filter").alias("content"))
    rows = D.filter_rows(signals)
    return rows.select("name", "seq", "kind", "fs", "freq", "q", (F.col("gain") + 0.0).alias("gain"), "n", "family", "order", "f0", "q0", "fp", "qp")


@query("catalogue_documents", sql_with("catalogue") + """select cast(cast(idx as bigint) % 64 as varchar) as idx, cast(cast(idx as bigint) // 64 as varchar) as file, title, author, case when year % 10 = 0 then 0 else year end as year,
 content_type, audio_types[1] as audio, cast(mv as double) as mv_adjust, '' as overview from catalogue""")
def catalogue_documents(spark, sf):
    rows = catalogue(spark, sf)
    n = F.col("idx").cast("long")
    doc = F.struct(
        "title", "author", F.when(F.col("year") % 10 == 0, "unknown").otherwise(F.col("year").cast("string")).alias("year"),
        "content_type", F.col("audio_types").alias("audioTypes"), "mv", F.floor(n / 64).cast("string").alias("note"),
    )
    files = rows.groupBy(F.floor(n / 64).alias("file")).agg(F.array_sort(F.collect_list(F.struct((n % 64).alias("at"), F.to_json(doc).alias("j"))))["j"].alias("j"))
    content = files.select(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")).alias("content"))
    out = D.parse_catalogue(content)
    return out.select("idx", F.col("note").alias("file"), "title", "author", "year", "content_type", F.col("audio_types")[0].alias("audio"), "mv_adjust", "overview")


@query("catalogue_array", sql_with("catalogue") + """select cast(idx as bigint) // 4096 as file, cast(cast(idx as bigint) % 4096 as varchar) as idx, title, author, year, content_type, audio_types[1] as audio,
 'in [' || cast(idx as varchar) || ', "{' || chr(92) || '"' as overview from catalogue""")
def catalogue_array(spark, sf):
    """Large catalogue arrays of 4096 entries, with brackets, quotes and backslashes in their texts, read in ranges of 16 KB."""
    n = F.col("idx").cast("long")
    doc = F.struct(
        "title", "author", F.col("year").cast("string").alias("year"), "content_type", F.col("audio_types").alias("audioTypes"),
        F.floor(n / 4096).cast("string").alias("note"), F.concat(F.lit("in ["), "idx", F.lit(', "{\\"')).alias("overview"),
    )
    folder = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    rows = catalogue(spark, sf).withColumn("at", n)
    write_files(rows, folder, F.floor(n / 4096), F.to_json(doc), ["at"], head="[\n", between=",\n", tail="\n]", extension=".json")
    out = D.read_catalogue(spark, folder, 1 << 14)
    return out.select(F.col("note").cast("long").alias("file"), "idx", "title", "author", "year", "content_type", F.col("audio_types")[0].alias("audio"), "overview")


@query("optimiser_documents", sql_with("filters") + """select cast(filter_set_id as varchar) as path, cast(seq as integer) as seq, kind, case when seq % 2 = 0 then 'L' else 'R' end as channel,
 format('{:.12g}', freq) as frequency, format('{:.12g}', q) as q, case when kind <> 'AllPass' then format('{:.12g}', gain + 0.0) end as gain from filters""")
def optimiser_documents(spark, sf):
    kind = F.col("kind")
    name = F.when(kind == "LowShelf", "LF_ShelfVarQ").when(kind == "HighShelf", "HF_ShelfVarQ").when(kind == "AllPass", "APF_VarQ").otherwise("PeakingEQ")
    each = F.struct(
        name.alias("_type"), F.array(F.when(F.col("seq") % 2 == 0, "L").otherwise("R")).alias("chans"),
        F.when(kind != "AllPass", F.col("gain")).alias("gain"), F.col("freq").alias("fc"), "q",
    )
    sets = filters(spark, sf).groupBy("filter_set_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.to_json(each).alias("j"))))["j"].alias("j"))
    docs = sets.select(F.col("filter_set_id").cast("string").alias("path"), F.concat(F.lit('{"mso_filters":['), F.array_join("j", ","), F.lit("]}")).alias("content"))
    return D.per_channel(D.optimiser_rows(docs)).select("path", "seq", "kind", "channel", "frequency", "q", "gain")


def _device_documents(spark, sf):
    """Two equal inputs per set; every fifth set differs in one value."""
    rows = filters(spark, sf).where(F.col("kind") != "AllPass")
    kind = F.when(F.col("kind") == "LowShelf", "SL").when(F.col("kind") == "HighShelf", "SH").otherwise("PK")
    both = rows.withColumn("ch", F.explode(F.array(F.lit(1), F.lit(2))))
    odd = (F.col("filter_set_id") % 5 == 0) & (F.col("ch") == 2) & (F.col("seq") < 4)
    item = F.concat(
        F.lit('<filter name="PEQ_'), F.col("ch").cast("string"), F.lit("_"), F.col("seq").cast("string"), F.lit('"><freq>'), F.col("freq").cast("string"),
        F.lit("</freq><q>"), F.when(odd, "9").otherwise((F.col("q")).cast("string")), F.lit("</q><boost>"), F.round("gain", 1).cast("string"), F.lit("</boost><type>"), kind,
        F.lit("</type><bypass>"), F.when(F.col("seq") == 6, "1").otherwise("0"), F.lit("</bypass><dec>0</dec></filter>"),
    )
    sets = both.groupBy("filter_set_id").agg(F.array_sort(F.collect_list(item)).alias("j"))
    return sets.select(F.col("filter_set_id").cast("string").alias("path"), F.concat(F.lit("<setting>"), F.array_join("j", ""), F.lit("</setting>")).alias("content"))


DEVICE = """, d as (select filter_set_id, case kind when 'LowShelf' then 'LowShelf' when 'HighShelf' then 'HighShelf' else 'PeakingEQ' end as kind, freq, q, round(gain, 1) as gain, seq from filters where kind <> 'AllPass'),
bad as (select distinct filter_set_id from d where filter_set_id % 5 = 0 and seq < 4)"""


@query("device_documents", sql_with("filters") + DEVICE + """, c as (select filter_set_id, kind, freq, q, gain, count(*) as c from d where seq <> 6 and filter_set_id not in (select filter_set_id from bad) group by all)
select cast(filter_set_id as varchar) as path, kind, freq, q, gain + 0.0 as gain, cast(case kind when 'PeakingEQ' then 1 else c end as integer) as n from c, lateral (select unnest(range(case kind when 'PeakingEQ' then c else 1 end)))""")
def device_documents(spark, sf):
    found, _ = D.device_filters(_device_documents(spark, sf))
    return found.select("path", "kind", "freq", "q", (F.col("gain") + 0.0).alias("gain"), "n")


@query("device_documents_rejected", sql_with("filters") + DEVICE + "select cast(filter_set_id as varchar) as path, 'inputs differ' as status from bad")
def device_documents_rejected(spark, sf):
    _, bad = D.device_filters(_device_documents(spark, sf))
    return bad


@query("probe_documents", """select cast(o_orderkey as varchar) as path, cast(1 as integer) as "index", 'audio' as codec_type,
 '1: ' || case when o_orderkey % 2 = 0 then 'DTS-HD MA' else 'TrueHD' end || ' - eng - 48000Hz 5.1 ' || ' - ' || cast((o_orderkey % 7200) // 3600 as varchar) || ':' || lpad(cast((o_orderkey % 3600) // 60 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || '.500000' as text,
 cast((o_orderkey % 7200)*1000000.0 + 500000 as double) as duration_us from orders
 union all select cast(o_orderkey as varchar), 0, 'video', '0: h264 (1920x1080)', (o_orderkey % 7200)*1000000.0::double + 500000 from orders""")
def probe_documents(spark, sf):
    key = F.col("o_orderkey")
    even = key % 2 == 0
    doc = F.to_json(F.struct(
        F.struct(F.concat((key % 7200).cast("string"), F.lit(".5")).alias("duration")).alias("format"),
        F.array(
            F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit("H.264").alias("codec_long_name"), F.lit(None).cast("string").alias("profile"),
                     F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("string").alias("channel_layout"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(None).cast("struct<language:string>").alias("tags")),
            F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.when(even, "dts").otherwise("truehd").alias("codec_name"), F.lit("TrueHD").alias("codec_long_name"), F.lit("DTS-HD MA").alias("profile"),
                     F.lit("48000").alias("sample_rate"), F.lit("5.1").alias("channel_layout"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.struct(F.lit("eng").alias("language")).alias("tags")),
        ).alias("streams"),
    ))
    files = table(spark, sf, "orders").select(key.cast("string").alias("path"), doc.alias("content"))
    return D.probe_streams(files)


@query("channel_names", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when c = 1 then 'track' when lay = 'none' or (lay = 'unknown' and c = 7) then 'track_c' || (ch + 1)
 when lay = '7.1' then 'track_' || (['FL','FR','FC','LFE','BL','BR','SL','SR'])[ch + 1]
 else 'track_' || (case c when 2 then ['FL','FR'] when 3 then ['FL','FR','LFE'] when 4 then ['FL','FR','FC','LFE'] when 5 then ['FL','FR','FC','LFE','BC'] when 6 then ['FL','FR','FC','LFE','SL','SR'] else ['FL','FR','FC','LFE','BL','BR','SL','SR'] end)[ch + 1] end as name
 from (select *, cast(l_linenumber - 1 as integer) as ch, cast(case when l_suppkey % 3 = 1 then 8 else greatest(l_linenumber, l_partkey % 8 + 1) end as integer) as c, (['unknown', '7.1', 'none'])[l_suppkey % 3 + 1] as lay from lineitem)""")
def channel_names(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    third = F.col("l_suppkey") % 3
    rows = li.select(
        "*", F.lit("track").alias("text"), (F.col("l_linenumber") - 1).cast("int").alias("channel_no"),
        F.when(third == 1, 8).otherwise(F.greatest(F.col("l_linenumber"), F.col("l_partkey") % 8 + 1)).cast("int").alias("channel_count"),
        F.element_at(F.array(F.lit("unknown"), F.lit("7.1"), F.lit("none")), (third + 1).cast("int")).alias("layout"),
    )
    return channel_name(spark, rows).select(*li.columns, "name")


METER = """select 's' || user_id as signal_id, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') as start, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') + interval '1 hour' as "end", count(*) as n,
 round(20*log10(max(abs(v))), 6) + 0.0 as peak_db, round(10*log10(avg(v*v)), 6) + 0.0 as rms_db from (select *, (value - 50.5::double)/500.0::double as v from events) group by all"""


def _meter_events(df):
    return df.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("signal_id"), "ts", ((F.col("value") - 50.5) / 500.0).alias("v"))


def _meter_out(df, *more):
    return df.select("signal_id", "start", "end", "n", *[rounded(F.col(c)).alias(c) for c in ("peak_db", "rms_db", *more)])


def _live(stream):
    """The events of a stream, at instants, and what takes the levels' times back to the type of the events' times."""
    if stream.schema["ts"].dataType.typeName() == "timestamp":
        return _meter_events(stream), lambda df: df
    back = lambda df: df.withColumns({c: V.clock(F.col(c)) for c in ("start", "end")})
    return _meter_events(stream.withColumn("ts", V.instant(F.col("ts")))), back


@query("window_levels", METER)
def window_levels(spark, sf):
    return _meter_out(V.window_levels(_meter_events(table(spark, sf, "events")), "1 hour"))


@query("live_levels", "select * from (" + METER + """) where "end" <= (select max(ts) - interval '2 hours' from events)""")
def live_levels(spark, sf):
    base = f"{shared_dir(spark)}/meter-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern fits one file as well as a folder
    stream, back = _live(stream)
    V.run_to_table(V.live_levels(stream, "1 hour", "2 hours"), f"{base}/out", f"{base}/checkpoint")
    return _meter_out(back(spark.read.schema("signal_id string, start timestamp, end timestamp, n bigint, peak_db double, rms_db double").parquet(f"{base}/out")))


@query("live_loudest", "select *, max(rms_db) over (partition by signal_id order by start) as loudest_db from (select * from (" + METER + """) where "end" <= (select max(ts) - interval '2 hours' from events))""")
def live_loudest(spark, sf):
    """The meter with state, stopped and started again between two batches of files."""
    base = f"{shared_dir(spark)}/loudest-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("t")).first().t
    kept = spark.conf.get(V.STATE_STORE[0], None)
    spark.conf.set(*V.STATE_STORE)
    try:
        for now in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
            events.where(now).write.mode("append").parquet(f"{base}/in")
            stream, back = _live(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
            V.run_to_table(V.loudest_windows(stream, "1 hour", "2 hours", "400 days"), f"{base}/out", f"{base}/checkpoint")
    finally:
        if kept is None:
            spark.conf.unset(V.STATE_STORE[0])
        else:
            spark.conf.set(V.STATE_STORE[0], kept)
    out = spark.read.schema(f"signal_id string, {V.LOUDEST}").parquet(f"{base}/out")
    return _meter_out(back(out), "loudest_db")


ENTRY = "digest string, title string, updated_at bigint"


@query("streamed_catalogue", sql_with("catalogue") + """, inc as (select idx as digest, title || ' v2' as title, updated_at + (cast(idx as bigint) % 3 - 1) * 1000 as updated_at from catalogue)
select c.idx as digest, case when i.updated_at > c.updated_at then i.title else c.title end as title, greatest(c.updated_at, i.updated_at) as updated_at from catalogue c join inc i on c.idx = i.digest""")
def streamed_catalogue(spark, sf):
    base = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    rows = catalogue(spark, sf)
    first = rows.select(F.col("idx").alias("digest"), "title", "updated_at")
    n = F.col("idx").cast("long")
    second = rows.select(F.col("idx").alias("digest"), F.concat("title", F.lit(" v2")).alias("title"), (F.col("updated_at") + (n % 3 - 1) * 1000).alias("updated_at"))
    for part in (first, second):  # two deliveries
        part.write.mode("append").json(f"{base}/in")
        I.ingest(spark.readStream.schema(ENTRY).json(f"{base}/in"), f"{base}/table", f"{base}/checkpoint")
    return I.current(spark, f"{base}/table", ENTRY)
