"""Registered queries on multichannel samples and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import channels as M
from lowtide.operators import routing as T
from lowtide.operators import samples as S
from lowtide.plans.registry import query
from lowtide.plans.spectral_queries import HIGH_4, LOW_4, sql_design, sql_recursion
from lowtide.plans.tables import _stored, channel_samples, routes, sql_with, table

W = sql_with("channel_samples")
KEYS = ["title", "channel"]


def channel_blocks(spark, sf, block=64):
    build = lambda: S.to_blocks(channel_samples(spark, sf).select("title", "channel", "i", "v", "fs"), [*KEYS, "fs"], block)
    return _stored(spark, sf, f"channel-blocks-{block}", build)


def _out(df, places=8):
    return df.withColumn("v", rounded(F.col("v"), places))


def titles(spark, sf):
    user = F.col("user_id")
    return table(spark, sf, "events").select((user - user % 6).alias("title")).distinct()


def bass_config(spark, sf):
    k = (F.col("title") / 6).cast("long")
    return titles(spark, sf).select(
        "title", F.lit(12.0).alias("lpf_hz"),
        F.element_at(F.array(F.lit("Before"), F.lit("After"), F.lit("Off")), (k % 3 + 1).cast("int")).alias("lpf_position"),
        F.when(k % 2 == 0, "WCS").otherwise("-7.5").alias("headroom_type"),
        (k % 2 == 1).alias("clip_before"), (k % 4 < 2).alias("clip_after"),
    )


BASS_CONFIG = """cfg as (select title, (['Before','After','Off'])[t // 6 % 3 + 1] as pos, case when t // 6 % 2 = 0 then 'WCS' else '-7.5' end as room,
 t // 6 % 2 = 1 as clip_before, t // 6 % 4 < 2 as clip_after from (select distinct title, title as t from channel_samples)),
cnt as (select title, count(distinct ch) as n from channel_samples group by 1),
hr as (select title, pos, clip_before, clip_after, case room when 'WCS' then 20*log10(n - 1 + pow(10, 0.5)) else abs(cast(room as double)) + 10 end as h from cfg join cnt using (title)),
scaled as (select s.title || '/' || s.channel as id, s.title, s.channel, s.i, s.v*pow(10.0::double, case when channel = 'LFE' then 10 - h else -h end / 20)*6 as v from channel_samples s join hr using (title))"""


@query("bass_managed_sum", W + ", " + BASS_CONFIG + ", " + sql_design(LOW_4) + ", " + sql_recursion("scaled", "ss", key="id") + """,
pre as (select s.title, s.channel, s.i, case when pos = 'Before' then r.y else s.v end as x, clip_before from scaled s join rec r on r.id = s.id and r.i = s.i join hr using (title)),
total as (select title as id, i, sum(case when clip_before then greatest(least(x, 1.0), -1.0) else x end) as v from pre group by all), """
       + sql_recursion("total", "ss", key="id", name="rec2") + """,
fin as (select t.id as title, t.i, case when pos = 'After' then r.y else t.v end as x, clip_after from total t join rec2 r on r.id = t.id and r.i = t.i join hr on hr.title = t.id)
select title, i, round(case when clip_after then greatest(least(x, 1.0), -1.0) else x end, 8) + 0.0 as v from fin""")
def bass_managed_sum(spark, sf):
    loud = S.map_blocks(channel_blocks(spark, sf), lambda v: v * 6.0)
    out = M.bass_manage(loud, bass_config(spark, sf))
    return _out(S.from_blocks(out, ["title"]))


@query("bass_managed_sum_dry_lfe", W + ", " + BASS_CONFIG + ", " + sql_design(LOW_4) + ", " + sql_recursion("scaled", "ss", key="id") + """,
pre as (select s.title, s.channel, s.i, case when pos = 'Before' and s.channel <> 'LFE' then r.y else s.v end as x, clip_before from scaled s join rec r on r.id = s.id and r.i = s.i join hr using (title)),
total as (select title as id, i, sum(case when clip_before then greatest(least(x, 1.0), -1.0) else x end) as v from pre group by all), """
       + sql_recursion("total", "ss", key="id", name="rec2") + """,
fin as (select t.id as title, t.i, case when pos = 'After' then r.y else t.v end as x, clip_after from total t join rec2 r on r.id = t.id and r.i = t.i join hr on hr.title = t.id)
select title, i, round(case when clip_after then greatest(least(x, 1.0), -1.0) else x end, 8) + 0.0 as v from fin""")
def bass_managed_sum_dry_lfe(spark, sf):
    """The low pass before the sum on the mains alone."""
    loud = S.map_blocks(channel_blocks(spark, sf), lambda v: v * 6.0)
    out = M.bass_manage(loud, bass_config(spark, sf).withColumn("lpf_lfe", F.lit(False)))
    return _out(S.from_blocks(out, ["title"]))


@query("bass_headroom", W + ", " + BASS_CONFIG + " select title, round(h, 6) as headroom_db from hr")
def bass_headroom(spark, sf):
    counts = channel_samples(spark, sf).select(*KEYS).distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    room = M.headroom_db(F.col("headroom_type"), F.col("n"))
    return bass_config(spark, sf).join(counts, "title").select("title", rounded(room).alias("headroom_db"))


@query("lfe_flag", W + "select title, channel, max(channel = 'LFE') as is_lfe from channel_samples group by all")
def lfe_flag(spark, sf):
    rows = channel_samples(spark, sf).select(*KEYS).distinct()
    return rows.withColumn("is_lfe", M.is_lfe(F.concat_ws("_", F.col("title").cast("string"), "channel")))


IDS = ", ids as (select title || '/' || channel as id, title, channel, i, v from channel_samples)"


@query("high_passed_mains", W + IDS + ", " + sql_design(HIGH_4) + ", " + sql_recursion("ids", "ss", key="id") + """
select title, channel, s.i, round(case when channel = 'LFE' then s.v else r.y end, 8) + 0.0 as v from ids s join rec r on r.id = s.id and r.i = s.i""")
def high_passed_mains(spark, sf):
    return _out(S.from_blocks(M.high_pass_mains(channel_blocks(spark, sf), KEYS, 6.0), KEYS))


@query("mono_mix", W + """, n as (select title, count(distinct channel) as n, bool_or(channel = 'LFE') as has_lfe from channel_samples group by 1)
select title, i, round(sum(v*case when not has_lfe then 1.0::double/n when channel = 'LFE' then pow(10.0::double, -10.2::double/20) else pow(10.0::double, -20.2::double/20) end), 8) + 0.0 as v
 from channel_samples join n using (title) group by all""")
def mono_mix(spark, sf):
    return _out(M.mono_mix(channel_samples(spark, sf)))


@query("mono_mix_without_lfe", W + """, m as (select * from channel_samples where channel <> 'LFE'), n as (select title, count(distinct channel) as n from m group by 1)
select title, i, round(sum(v/n), 8) + 0.0 as v from m join n using (title) group by all""")
def mono_mix_without_lfe(spark, sf):
    return _out(M.mono_mix(channel_samples(spark, sf).where(F.col("channel") != "LFE")))


@query("bass_remix", W + IDS + ", " + sql_design(LOW_4 + [("HighPass2", 12.0, 0.5 ** 0.5, 0.0)] * 2) + ", " + sql_recursion("ids", "ss", key="id", name="lo") + ", "
       + sql_recursion("ids", "ss", key="id", name="hi").replace("b0_1", "b0_3").replace("b1_1", "b1_3").replace("b2_1", "b2_3").replace("a1_1", "a1_3").replace("a2_1", "a2_3")
       .replace("b0_0", "b0_2").replace("b1_0", "b1_2").replace("b2_0", "b2_2").replace("a1_0", "a1_2").replace("a2_0", "a2_2") + """,
o as (select title, channel, s.i, r.y as v from ids s join hi r on r.id = s.id and r.i = s.i where channel <> 'LFE'
 union all select title, 'LFE', s.i, case when channel = 'LFE' then s.v*pow(10.0::double, -10.0::double/20) else r.y*pow(10.0::double, -15.0::double/20) end from ids s join lo r on r.id = s.id and r.i = s.i)
select title, channel, i, round(sum(v), 8) + 0.0 as v from o group by all""")
def bass_remix(spark, sf):
    return _out(S.from_blocks(M.remix_bass(channel_blocks(spark, sf), 12.0), KEYS))


def _mixed(spark, sf, mode):
    out = M.mix(channel_samples(spark, sf), mode, "FC", "FL", -3.0)
    return _out(out.select(*KEYS, "i", "v"))


G = "pow(10.0::double, -3.0::double/20)"
MIX = """, o as ({0}) select title, channel, i, round(sum(v), 8) + 0.0 as v from o group by all"""


@query("mix_add", W + MIX.format(f"select title, channel, i, v from channel_samples union all select title, 'FL', i, v*{G} from channel_samples where channel = 'FC'"))
def mix_add(spark, sf):
    return _mixed(spark, sf, "add")


@query("mix_subtract", W + MIX.format(f"select title, channel, i, v from channel_samples union all select title, 'FL', i, -v*{G} from channel_samples where channel = 'FC'"))
def mix_subtract(spark, sf):
    return _mixed(spark, sf, "subtract")


@query("mix_copy", W + MIX.format(f"select title, channel, i, v from channel_samples where channel <> 'FL' union all select title, 'FL', i, v*{G} from channel_samples where channel = 'FC'"))
def mix_copy(spark, sf):
    return _mixed(spark, sf, "copy")


@query("mix_move", W + MIX.format(f"select title, channel, i, case when channel = 'FC' then 0.0::double else v end as v from channel_samples where channel <> 'FL' union all select title, 'FL', i, v*{G} from channel_samples where channel = 'FC'"))
def mix_move(spark, sf):
    return _mixed(spark, sf, "move")


@query("mix_swap", W + MIX.format(f"select title, case channel when 'FC' then 'FL' when 'FL' then 'FC' else channel end as channel, i, case when channel in ('FC','FL') then v*{G} else v end as v from channel_samples"))
def mix_swap(spark, sf):
    return _mixed(spark, sf, "swap")


OPS = [
    {"kind": "gain", "channels": ["FL", "FR"], "value": -2.5},
    {"kind": "delay", "channels": ["FR", "LFE"], "value": 100.0},
    {"kind": "polarity", "channels": ["LFE"]},
    {"kind": "gain", "channels": ["FC"], "value": 6.0, "enabled": False},
    {"kind": "mute", "channels": ["BR"]},
]


@query("channel_operations", W + """select g.title, g.channel, g.i, round(case when g.channel = 'BR' then 0.0::double
 else coalesce(s.v, 0.0::double)*case when g.channel in ('FL','FR') then pow(10.0::double, -2.5::double/20) when g.channel = 'LFE' then -1.0::double else 1.0::double end end, 8) + 0.0 as v
 from channel_samples g left join channel_samples s on s.title = g.title and s.channel = g.channel and s.i = g.i - case when g.channel in ('FR','LFE') then 6 else 0 end""")
def channel_operations(spark, sf):
    return _out(M.apply_ops(channel_samples(spark, sf), OPS).select(*KEYS, "i", "v"))


def title_routes(spark, sf):
    """Each channel of a title goes to two outputs by way 0 and 1."""
    user = F.col("user_id")
    ch, title = (user % 6).cast("int"), user - user % 6
    each = table(spark, sf, "events").select("user_id").distinct().withColumn("w", F.explode(F.array(F.lit(0), F.lit(1))))
    return each.select(title.alias("title"), ch.alias("i"), "w", ((ch * 2 + F.col("w") * (title / 6 % 3).cast("int")) % 4).alias("o"))


TITLE_ROUTES = """, tr as (select distinct title, ch, cast((ch*2 + w*(title // 6 % 3)) % 4 as integer) as o from (select distinct title, ch from channel_samples), (select unnest([0, 1]) as w))"""


@query("routed_samples", W + TITLE_ROUTES + " select title, o, i, round(sum(v), 8) + 0.0 as v from channel_samples join tr using (title, ch) group by all")
def routed_samples(spark, sf):
    return _out(M.route(channel_samples(spark, sf), title_routes(spark, sf)))


@query("sum_of_ways", W + "select title, i, round(sum(v), 8) + 0.0 as v from channel_samples group by all")
def sum_of_ways(spark, sf):
    return _out(M.sum_ways(channel_samples(spark, sf), ["title"]))


@query("gain_adjustments", W + "select distinct title, channel, case when channel = 'LFE' then -4.0::double else 1.5::double end as gain_db from channel_samples")
def gain_adjustments(spark, sf):
    return M.gain_rows(channel_samples(spark, sf).select(*KEYS).distinct(), 1.5, -4.0)


@query("normalised_delays", W + """, d as (select distinct title, channel, (ch*7 + title) % 4 / 8.0::double as delay_ms from channel_samples), m as (select *, max(delay_ms) over (partition by title) as mx from d)
select title, round(mx - delay_ms, 6) as delay_ms, array_to_string(list_sort(list(channel)), ',') as channels from m where mx <> delay_ms group by all""")
def normalised_delays(spark, sf):
    d = channel_samples(spark, sf).select("title", "channel", ((F.col("ch") * 7 + F.col("title")) % 4 / 8.0).alias("delay_ms")).distinct()
    return M.normalise_delays(d).withColumn("channels", F.array_join("channels", ","))


R = sql_with("routes")


@query("direct_routes", R + """select matrix_id, min(i) as i, min(w) as w, o from routes group by matrix_id, o having count(*) = 1 and min(i) <> o""")
def direct_routes(spark, sf):
    return T.direct(routes(spark, sf))


SUMMED = ", sm as (select matrix_id, o, array_to_string(list_sort(list(i || '_' || w)), ',') as inputs from routes group by all having count(*) > 1)"


@query("summed_routes", R + SUMMED + " select matrix_id, o, inputs from sm")
def summed_routes(spark, sf):
    return T.summed(routes(spark, sf)).withColumn("inputs", F.array_join("inputs", ","))


@query("collated_routes", R + SUMMED + " select matrix_id, inputs, array_to_string(list_sort(list(o)), ',') as outputs from sm group by all")
def collated_routes(spark, sf):
    out = T.collated(routes(spark, sf))
    return out.select("matrix_id", F.array_join("inputs", ",").alias("inputs"), F.array_join(F.col("outputs").cast("array<string>"), ",").alias("outputs"))


@query("free_outputs", R + "select matrix_id, cast(o as integer) as o from (select distinct matrix_id from routes), (select unnest(range(1, 9)) as o) where (matrix_id, o) not in (select matrix_id, o from routes)")
def free_outputs(spark, sf):
    rows = routes(spark, sf)
    every = rows.select("matrix_id").distinct().withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return T.free_outputs(rows, every)


@query("outputs_by_way", R + """, ww as (select matrix_id, i, w, w || ':' || array_to_string(list_sort(list(o)), ',') as t from routes group by matrix_id, i, w)
select matrix_id, i, array_to_string(list(t order by w), ';') as ways from ww group by all""")
def outputs_by_way(spark, sf):
    out = T.outputs_by_way(routes(spark, sf))
    text = lambda x: F.concat(x["w"].cast("string"), F.lit(":"), F.array_join(x["outputs"].cast("array<string>"), ","))
    return out.select("matrix_id", "i", F.array_join(F.transform("ways", text), ";").alias("ways"))


@query("routing_violations", R + """, di as (select matrix_id, o from routes group by matrix_id, o having count(*) = 1 and min(i) <> o),
sig as (select matrix_id, o, list_sort(list(i || '_' || w)) as s from routes group by all having count(*) > 1),
rd as (select distinct g.matrix_id, g.s, r.i as o from sig g join routes r on r.matrix_id = g.matrix_id and r.o = g.o)
select matrix_id, o, 'overwrites input' as problem from di where (matrix_id, o) in (select matrix_id, i from routes)
union all select distinct w.matrix_id, w.o, 'feeds another sum' from sig w join rd on rd.matrix_id = w.matrix_id and rd.o = w.o and rd.s <> w.s""")
def routing_violations(spark, sf):
    return T.violations(routes(spark, sf))


@query("encoded_routes", R + "select matrix_id, i || '/' || w || '/' || o as route from routes")
def encoded_routes(spark, sf):
    return T.encode(routes(spark, sf))


@query("decoded_routes", R + "select matrix_id, i, w, o from routes")
def decoded_routes(spark, sf):
    return T.decode(T.encode(routes(spark, sf)))


def linked_signals(spark, sf):
    """Users with a low mean value are the known signals; each title's first channel is
    the master of the others."""
    user = F.col("user_id")
    ids = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean"))
    signals = ids.where("mean < 58").select(user.alias("signal_id"), (user + 1000).alias("filter_set_id"))
    links = ids.select((user - user % 6).alias("master"), user.alias("slave")).where("master <> slave")
    return signals, links


LINKS = "with ids as (select user_id as u, avg(value) as mean from events group by 1), sg as (select u as signal_id, u + 1000 as filter_set_id from ids where mean < 58), ln as (select u - u % 6 as master, u as slave from ids where u - u % 6 <> u) "


@query("active_filters", LINKS + "select s.signal_id, l.master, coalesce(m.filter_set_id, s.filter_set_id) as active_set from sg s left join ln l on l.slave = s.signal_id left join sg m on m.signal_id = l.master")
def active_filters(spark, sf):
    return M.active_filters(*linked_signals(spark, sf))


@query("valid_links", LINKS + "select master, slave from ln where master in (select signal_id from sg) and slave in (select signal_id from sg)")
def valid_links(spark, sf):
    signals, links = linked_signals(spark, sf)
    return M.valid_links(links, signals)


@query("complete_groups", LINKS + "select u - u % 6 as title, count(*) as expected from ids left join sg on signal_id = u group by 1 having count(*) = count(signal_id)")
def complete_groups(spark, sf):
    signals, _ = linked_signals(spark, sf)
    user = F.col("user_id")
    groups = table(spark, sf, "events").select("user_id").distinct().select((user - user % 6).alias("title"), user.alias("signal_id"))
    return M.complete_groups(groups, signals)


@query("signals_by_channel_name", W + "select distinct channel, 'title_' || title || '_' || channel as name, title, ch from channel_samples")
def signals_by_channel_name(spark, sf):
    rows = channel_samples(spark, sf).select("title", "channel", "ch").distinct()
    named = rows.select("title", F.concat(F.lit("title_"), F.col("title").cast("string"), F.lit("_"), F.col("channel")).alias("name"))
    return M.match_channels(named, rows.select("channel", "ch").distinct())


@query("least_headroom", W + IDS + ", " + sql_design(LOW_4) + ", " + sql_recursion("ids", "ss", key="id", gain="9.0") + """, h as (select id, -20*log10(max(abs(y))) as h from rec where i >= 0 group by 1)
select cast(split_part(id, '/', 1) as bigint) as title, round(least(min(h), 0.0), 6) + 0.0 as headroom_db from h group by 1""")
def least_headroom(spark, sf):
    from lowtide.plans import pipelines
    from lowtide.plans.spectral_queries import sos_of

    done = pipelines.filter_signal(channel_blocks(spark, sf), KEYS, gain=9.0, active=sos_of(spark, LOW_4))
    out = M.least_headroom(S.from_blocks(done, KEYS), KEYS, ["title"])
    return out.select("title", rounded(F.col("headroom_db")).alias("headroom_db"))


LINKED = """, act as (select id, title, channel, i, v, ch in (0, 1, 2) as filtered from (select s.title || '/' || s.channel as id, s.* from channel_samples s)),
mains as (select a.*, a.v*pow(10.0::double, case when channel = 'LFE' then 10 - h else -h end/20) as x from act a join (select title, 20*log10(count(distinct ch) - 1 + pow(10, 0.5)) as h from channel_samples group by 1) using (title)),
src as (select id, i, x as v from mains)"""


@query("bass_level_report", W + LINKED + ", " + sql_design([("LowShelf", 8.0, 0.8, 5.0), ("PeakingEQ", 14.0, 1.2, -4.0)]) + ", " + sql_recursion("src", "ss", key="id") + """,
s as (select m.title, m.i, sum(case when filtered then r.y else m.x end) as v from mains m join rec r on r.id = m.id and r.i = m.i group by all)
select title, round(10*log10(avg(v*v)), 6) as rms_db, round(20*log10(max(abs(v))), 6) as peak_db from s group by 1""")
def bass_level_report(spark, sf):
    """Linked filters, bass management and levels for every title."""
    from lowtide.operators import stats
    from lowtide.plans import pipelines
    from lowtide.plans.spectral_queries import DESIGN, sos_of

    blocks = channel_blocks(spark, sf)
    first = F.col("channel").isin("FL", "FR", "FC")
    names = blocks.select(*KEYS).distinct()
    signal = F.concat_ws("/", F.col("title").cast("string"), "channel")
    signals = names.select(signal.alias("signal_id"), F.when(F.col("channel") == "FL", "A").alias("filter_set_id"))
    links = names.where(first & (F.col("channel") != "FL")).select(
        F.concat_ws("/", F.col("title").cast("string"), F.lit("FL")).alias("master"), signal.alias("slave")
    )
    config = titles(spark, sf).select(
        "title", F.lit(12.0).alias("lpf_hz"), F.lit("Off").alias("lpf_position"), F.lit("WCS").alias("headroom_type"),
        F.lit(False).alias("clip_before"), F.lit(False).alias("clip_after"),
    )
    sets = {"A": sos_of(spark, DESIGN)}
    managed = pipelines.bass_managed(blocks, config, signals, links, sets)
    out = stats.levels(S.from_blocks(managed, ["title"]), ["title"])
    return out.select("title", rounded(F.col("rms_db")).alias("rms_db"), rounded(F.col("peak_db")).alias("peak_db"))
