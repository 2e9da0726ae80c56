"""Registered queries on sample series and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import samples as S
from lowtide.operators import stats as A
from lowtide.operators.ordering import running_sum
from lowtide.plans.registry import query
from lowtide.plans.tables import channel_samples, sample_blocks, samples, sql_with, table

KEY = ["signal_id"]
W = sql_with("samples")


@query("level_report", W + """select signal_id, round(10*log10(avg(v*v)), 6) as rms_db,
 round(20*log10(max(abs(v))), 6) as peak_db,
 round(20*log10(max(abs(v))) - 10*log10(avg(v*v)), 6) as crest_db,
 round(-20*log10(max(abs(v))), 6) as headroom_db from samples group by signal_id""")
def level_report(spark, sf):
    out = A.levels(samples(spark, sf), KEY)
    return out.select(*KEY, *[rounded(F.col(c)).alias(c) for c in out.columns if c != "signal_id"])


@query("rms_level", W + "select signal_id, round(10*log10(avg(v*v)), 6) as rms_db from samples group by 1")
def rms_level(spark, sf):
    return A.levels(samples(spark, sf), KEY).select(*KEY, rounded(F.col("rms_db")).alias("rms_db"))


@query("peak_headroom", W + "select signal_id, round(-20*log10(max(abs(v))), 6) as headroom_db from samples group by 1")
def peak_headroom(spark, sf):
    return A.headroom(samples(spark, sf), KEY).select(*KEY, rounded(F.col("headroom_db")).alias("headroom_db"))


@query("crest_factor", W + """select signal_id,
 round(20*log10(max(abs(v))) - 10*log10(avg(v*v)), 6) as crest_db from samples group by 1""")
def crest_factor(spark, sf):
    return A.levels(samples(spark, sf), KEY).select(*KEY, rounded(F.col("crest_db")).alias("crest_db"))


WINDOWED = """, win as (select signal_id, kind, win, i // win as w, sum(v*v) as e
 from samples, (values ('instant', 2), ('fast', 8), ('slow', 64)) t(kind, win) group by all),
peaks as (select signal_id, kind, max(case when e > 0 then 10*log10(e/win) else -120.0::double end) as db
 from win group by all)
"""


@query("windowed_peaks", W + WINDOWED + "select signal_id, kind, round(db, 6) as db from peaks")
def windowed_peaks(spark, sf):
    return A.windowed_peaks(samples(spark, sf), KEY).withColumn("db", rounded(F.col("db")))


@query("custom_windowed_peak", W + """, e as (select signal_id, i // 20 as w, sum(v*v) as e from samples group by all)
select signal_id, 'custom' as kind, round(max(10*log10(e/20)), 6) as db from e group by 1""")
def custom_windowed_peak(spark, sf):
    out = A.windowed_peaks(samples(spark, sf), KEY, {"custom": 0.3125})
    return out.withColumn("db", rounded(F.col("db")))


ALL_LEVELS = WINDOWED + """, lev as (select signal_id, kind, db from peaks union all
 select signal_id, 'rms', 10*log10(avg(v*v)) from samples group by 1),
comp as (select signal_id, 10*log10(avg(pow(10.0::double, db/10))) as composite_db from lev group by 1)
"""


def _all_levels(spark, sf):
    rows = samples(spark, sf)
    rms = A.levels(rows, KEY).select(*KEY, F.lit("rms").alias("kind"), F.col("rms_db").alias("db"))
    return A.windowed_peaks(rows, KEY).unionByName(rms)


@query("composite_level", W + ALL_LEVELS + "select signal_id, round(composite_db, 6) as composite_db from comp")
def composite_level(spark, sf):
    out = A.composite(_all_levels(spark, sf), KEY, ["rms", "instant", "fast", "slow"])
    return out.withColumn("composite_db", rounded(F.col("composite_db")))


@query("level_rating", W + ALL_LEVELS + """select signal_id, cast(case when composite_db + 1.5 >= -15.5 then 5
 when composite_db + 1.5 >= -18 then 4 when composite_db + 1.5 >= -20.5 then 3
 when composite_db + 1.5 >= -23 then 2 else 1 end as integer) as rating from comp""")
def level_rating(spark, sf):
    out = A.composite(_all_levels(spark, sf), KEY, ["rms", "instant", "fast", "slow"])
    return out.select(*KEY, A.rate_level(F.col("composite_db"), 1.5).alias("rating"))


@query("dynamics_rating", W + ALL_LEVELS + """, d as (select signal_id,
 max(db) filter (kind='instant') - max(db) filter (kind='rms') as dynamics_db from lev group by 1)
select signal_id, round(dynamics_db, 6) as dynamics_db, cast(case when dynamics_db + 14 >= 27.5 then 5
 when dynamics_db + 14 >= 25 then 4 when dynamics_db + 14 >= 22.5 then 3 when dynamics_db + 14 >= 20 then 2
 else 1 end as integer) as rating from d""")
def dynamics_rating(spark, sf):
    lev = _all_levels(spark, sf)
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("db")))
    d = lev.groupBy(*KEY).agg((one("instant") - one("rms")).alias("dynamics_db"))
    return d.select(
        *KEY, rounded(F.col("dynamics_db")).alias("dynamics_db"),
        A.rate_dynamics(F.col("dynamics_db") + 14.0).alias("rating"),
    )


@query("peak_position", W + "select signal_id, min_by(i, (-v, i)) / 64.0::double as peak_t from samples group by 1")
def peak_position(spark, sf):
    return A.peak_position(samples(spark, sf), KEY)


@query("durations", W + """, d as (select signal_id, (max(i)+1)/64.0::double as seconds,
 cast((max(i)+1)*15625 as bigint) as us from samples group by 1)
select signal_id, seconds, '0:00:' || lpad(cast(us // 1000000 as varchar), 2, '0')
 || case when us % 1000000 = 0 then '' else '.' || lpad(cast(us % 1000000 as varchar), 6, '0') end as duration,
 '0:00:02' as start, '0:00:' || lpad(cast((us+2000000) // 1000000 as varchar), 2, '0')
 || case when us % 1000000 = 0 then '' else '.' || lpad(cast(us % 1000000 as varchar), 6, '0') end as "end" from d""")
def durations(spark, sf):
    return A.durations(samples(spark, sf), KEY, 2.0)


@query("total_duration", W + """select sum(n / 64.0::double) as seconds from
 (select signal_id, max(i)+1 as n from samples group by 1)""")
def total_duration(spark, sf):
    signals = samples(spark, sf).groupBy(*KEY).agg((F.max("i") + 1).alias("n"), F.first("fs").alias("fs"))
    return S.total_seconds(signals)


@query("sweep_summary", """select l_linenumber as "order", round(avg(l_extendedprice), 4) as mean,
 round(median(l_extendedprice), 6) as median, round(stddev_pop(l_extendedprice), 4) as std from lineitem group by 1""")
def sweep_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("order"), "l_extendedprice")
    out = A.sweep_summary(rows, "order", "l_extendedprice")
    return out.select("order", rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("median")).alias("median"),
                      rounded(F.col("std"), 4).alias("std"))


@query("gain", W + "select signal_id, i, v * 0.37::double as v from samples")
def gain(spark, sf):
    return S.adjust_gain(samples(spark, sf), 0.37).select(*KEY, "i", "v")


@query("gain_on_blocks", W + "select signal_id, i, v * 0.37::double as v from samples")
def gain_on_blocks(spark, sf):
    return S.from_blocks(S.map_blocks(sample_blocks(spark, sf), lambda v: v * 0.37), KEY)


@query("offset", W + "select signal_id, i, round(v * pow(10.0::double, -4.5::double/20), 9) as v from samples")
def offset(spark, sf):
    return S.offset(samples(spark, sf), -4.5).select(*KEY, "i", rounded(F.col("v"), 9).alias("v"))


@query("clip", W + "select signal_id, i, greatest(least(v * 2, 1.0::double), -1.0::double) as v from samples")
def clip(spark, sf):
    return S.clip(S.adjust_gain(samples(spark, sf), 2.0)).select(*KEY, "i", "v")


@query("invert", W + "select signal_id, i, -v + 0.0 as v from samples")
def invert(spark, sf):
    return S.invert(samples(spark, sf)).select(*KEY, "i", (F.col("v") + 0.0).alias("v"))


@query("zero", W + "select signal_id, i, 0.0::double as v from samples")
def zero(spark, sf):
    return S.zero(samples(spark, sf)).select(*KEY, "i", "v")


@query("copy_signal", W + "select signal_id || '-copy' as signal_id, i, v from samples")
def copy_signal(spark, sf):
    return S.copy_as(samples(spark, sf), F.concat("signal_id", F.lit("-copy"))).select(*KEY, "i", "v")


@query("waveform_db", W + """select signal_id, i,
 round(20*log10(case when v = 0 then 1e-9::double else abs(v) end), 6) as db from samples""")
def waveform_db(spark, sf):
    return S.waveform_db(samples(spark, sf)).select(*KEY, "i", rounded(F.col("db")).alias("db"))


@query("time_axis", W + "select signal_id, i, i / 64.0::double as t from samples")
def time_axis(spark, sf):
    return S.time_axis(samples(spark, sf)).select(*KEY, "i", "t")


@query("cut", W + """, n as (select signal_id, (max(i)+1)/64.0::double as d from samples group by 1)
select signal_id, i, v from samples join n using (signal_id)
where 0.2 >= d or 1.0 > d or (i between floor(0.2::double*64) and floor(1.0::double*64))""")
def cut(spark, sf):
    return S.cut(samples(spark, sf), KEY, 0.2, 1.0).select(*KEY, "i", "v")


SHIFTED = """, n as (select signal_id, max(i)+1 as n from samples group by 1)
select g.signal_id, g.i, coalesce(s.v, 0.0::double) as v from samples g
left join samples s on s.signal_id = g.signal_id and s.i = g.i - ({by})"""


@query("delay", W + SHIFTED.format(by="floor(200*64/1000.0)"))
def delay(spark, sf):
    return S.shift(samples(spark, sf), KEY, 200.0).select(*KEY, "i", "v")


@query("advance", W + SHIFTED.format(by="floor(-330*64/1000.0)"))
def advance(spark, sf):
    return S.shift(samples(spark, sf), KEY, -330.0).select(*KEY, "i", "v")


@query("step_response", W + """, t as (select signal_id, i, v, lag(v) over (partition by signal_id order by i) as pv from samples)
select signal_id, i, round(sum(case when pv is null then 0.0::double else (v + pv)/2/64 end)
 over (partition by signal_id order by i), 12) + 0.0 as y from t""")
def step_response(spark, sf):
    out = S.step_response(samples(spark, sf), KEY, block=1 << 16)
    return out.select(*KEY, "i", rounded(F.col("y"), 12).alias("y"))


@query("concatenate", sql_with("channel_samples") + """, n as (select title, ch, max(i)+1 as n from channel_samples group by all),
s as (select title, ch, coalesce(sum(n) over (partition by title order by ch rows between unbounded preceding and 1 preceding), 0) as b from n)
select title as merged_id, cast(i + b as bigint) as i, v, fs from channel_samples join s using (title, ch)""")
def concatenate(spark, sf):
    rows = channel_samples(spark, sf).withColumn("part", F.col("title") + F.col("ch"))
    plan = rows.select("part", F.col("title").alias("merged_id"), F.col("ch").alias("ord")).distinct()
    return S.concatenate(rows.select("part", "i", "v", "fs"), "part", plan)


@query("pulse_per_signal", W + """, n as (select signal_id, max(i)+1 as n from samples group by 1)
select signal_id, cast(k as bigint) as i, case when k = n // 2 then 1.0::double else 0.0::double end as v
 from n, lateral (select unnest(range(cast(n as bigint))) as k)""")
def pulse_per_signal(spark, sf):
    return S.pulses(S.lengths(samples(spark, sf), KEY), KEY)


@query("running_energy", W + """select signal_id, i, round(sum(v*v) over (partition by signal_id order by i), 12) as e from samples""")
def running_energy(spark, sf):
    out = running_sum(samples(spark, sf), KEY, "i", F.col("v") * F.col("v"), "e")
    return out.select(*KEY, "i", rounded(F.col("e"), 12).alias("e"))
