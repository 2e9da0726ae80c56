"""Registered queries on filter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions import biquad, text
from lowtide.functions.levels import rounded
from lowtide.functions.tables import bessel_rows
from lowtide.operators import filters as O
from lowtide.plans.registry import query
from lowtide.plans.tables import filters, sql_with, table

POINTS = 64

# Textbook coefficients, written once for the comparison engine.
COEF = """{src}_w as (select *, 2*pi()*freq/fs as w, sin(2*pi()*freq/fs)/(2*q) as al,
  pow(10.0::double, round(gain, 3)/40) as am from {src}),
{src}_raw as (select *,
 case kind when 'PeakingEQ' then [1+al*am, -2*cos(w), 1-al*am, 1+al/am, -2*cos(w), 1-al/am]
  when 'LowShelf' then [am*((am+1)-(am-1)*cos(w)+2*sqrt(am)*al), 2*am*((am-1)-(am+1)*cos(w)),
    am*((am+1)-(am-1)*cos(w)-2*sqrt(am)*al), (am+1)+(am-1)*cos(w)+2*sqrt(am)*al, -2*((am-1)+(am+1)*cos(w)),
    (am+1)+(am-1)*cos(w)-2*sqrt(am)*al]
  when 'HighShelf' then [am*((am+1)+(am-1)*cos(w)+2*sqrt(am)*al), -2*am*((am-1)+(am+1)*cos(w)),
    am*((am+1)+(am-1)*cos(w)-2*sqrt(am)*al), (am+1)-(am-1)*cos(w)+2*sqrt(am)*al, 2*((am-1)-(am+1)*cos(w)),
    (am+1)-(am-1)*cos(w)-2*sqrt(am)*al]
  when 'LowPass2' then [(1-cos(w))/2, 1-cos(w), (1-cos(w))/2, 1+al, -2*cos(w), 1-al]
  when 'HighPass2' then [(1+cos(w))/2, -(1+cos(w)), (1+cos(w))/2, 1+al, -2*cos(w), 1-al]
  when 'LowPass1' then [1-exp(-2*pi()*round(freq,2)/fs), 0, 0, 1, -exp(-2*pi()*round(freq,2)/fs), 0]
  when 'HighPass1' then [1, -1, 0, tan(pi()*freq/fs)+1, tan(pi()*freq/fs)-1, 0]
  else [1-al, -2*cos(w), 1+al, 1+al, -2*cos(w), 1-al] end as c from {src}_w),
{dst} as (select *, c[1]/c[4] as b0, c[2]/c[4] as b1, c[3]/c[4] as b2, c[5]/c[4] as a1, c[6]/c[4] as a2,
 case when kind in ('LowShelf','HighShelf') then n else 1 end as copies from {src}_raw)
"""


def coef(src="filters", dst="coef"):
    return COEF.format(src=src, dst=dst)


RESPONSE = """, grid as (select unnest(range({points})) as k),
resp as (select {keys}, seq, fs, k, copies * 10*log10(greatest(
   pow(b0+b1+b2,2) - 4*phi*(b0*b1+4*b0*b2+b1*b2) + 16*phi*phi*b0*b2, 1e-300)
  / (pow(1+a1+a2,2) - 4*phi*(a1+4*a2+a1*a2) + 16*phi*phi*a2)) as db,
 copies * degrees(atan2(-(b1*sin(x))-b2*sin(2*x), b0+b1*cos(x)+b2*cos(2*x))
  - atan2(-(a1*sin(x))-a2*sin(2*x), 1+a1*cos(x)+a2*cos(2*x))) as ph
 from (select *, pow(sin(x/2),2) as phi from (select *, k*pi()/{points} as x from {src}, grid)))
"""

W = sql_with("filters", extra=coef())
COEFS = ", ".join(f"round({c}, 9) + 0.0 as {c}" for c in ("b0", "b1", "b2", "a1", "a2"))
KEYS = ["filter_set_id", "seq"]


def _coefs(df, *extra):
    terms = [rounded(F.col("sos")[c], 9).alias(c) for c in ("b0", "b1", "b2", "a1", "a2")]
    return df.select(*KEYS, *extra, *terms)


@query("peaking_coefficients", W + f"select filter_set_id, seq, {COEFS} from coef where kind = 'PeakingEQ'")
def peaking_coefficients(spark, sf):
    return _coefs(O.with_sections(filters(spark, sf).where(F.col("kind") == "PeakingEQ")))


@query("shelf_coefficients", W + f"select filter_set_id, seq, {COEFS} from coef where kind in ('LowShelf','HighShelf')")
def shelf_coefficients(spark, sf):
    return _coefs(O.with_sections(filters(spark, sf).where(F.col("kind").isin("LowShelf", "HighShelf"))))


@query("shelf_cascade", W + f"""select filter_set_id, seq, cast(copy as integer) as copy, {COEFS} from coef,
 lateral (select unnest(range(1, n + 1)) as copy) where kind in ('LowShelf','HighShelf')""")
def shelf_cascade(spark, sf):
    rows = O.unroll(filters(spark, sf).where(F.col("kind").isin("LowShelf", "HighShelf")))
    return _coefs(O.with_sections(rows), "copy")


def _as_kind(spark, sf, *kinds):
    """The filter table with its kinds replaced in turn, to cover every kind."""
    pick = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("seq") % len(kinds) + 1).cast("int"))
    return filters(spark, sf).withColumn("kind", pick)


def _sql_kind(*kinds):
    names = ", ".join(f"'{k}'" for k in kinds)
    extra = f"other as (select * replace (([{names}])[seq % {len(kinds)} + 1] as kind) from filters),\n"
    return sql_with("filters", extra=extra + coef("other"))


@query("one_pole_coefficients", _sql_kind("LowPass1", "HighPass1") + f"select filter_set_id, seq, kind, {COEFS} from coef")
def one_pole_coefficients(spark, sf):
    return _coefs(O.with_sections(_as_kind(spark, sf, "LowPass1", "HighPass1")), "kind")


@query("two_pole_coefficients",
       _sql_kind("LowPass2", "HighPass2", "AllPass") + f"select filter_set_id, seq, kind, {COEFS} from coef")
def two_pole_coefficients(spark, sf):
    return _coefs(O.with_sections(_as_kind(spark, sf, "LowPass2", "HighPass2", "AllPass")), "kind")


@query("linkwitz_transform", sql_with("filters", extra="""lt as (select *, freq as f0, q as q0, freq * 0.7 as fp, 0.707::double as qp from filters),
t as (select *, 2*pi()*(f0+fp)/2/tan(pi()*(f0+fp)/2/fs) as s, 2*pi()*f0 as w0, 2*pi()*fp as wp from lt),
u as (select *, wp*wp + s*wp/qp + s*s as d from t)""") + """select filter_set_id, seq,
 round((w0*w0 + s*w0/q0 + s*s)/d, 9) as b0, round(2*(w0*w0 - s*s)/d, 9) as b1, round((w0*w0 - s*w0/q0 + s*s)/d, 9) as b2,
 round(2*(wp*wp - s*s)/d, 9) as a1, round((wp*wp - s*wp/qp + s*s)/d, 9) as a2 from u""")
def linkwitz_transform(spark, sf):
    rows = filters(spark, sf).select(
        *KEYS, F.lit("LinkwitzTransform").alias("kind"), "fs", F.col("freq").alias("f0"), F.col("q").alias("q0"),
        (F.col("freq") * 0.7).alias("fp"), F.lit(0.707).alias("qp"),
    )
    return _coefs(O.with_sections(rows))


@query("gain_sections", sql_with("filters") + """select filter_set_id, seq, kind,
 round(case kind when 'Gain' then pow(10.0::double, gain/20) else 1.0::double end, 9) as b0 from
 (select * replace (case when seq % 2 = 0 then 'Gain' else 'Passthrough' end as kind) from filters)""")
def gain_sections(spark, sf):
    rows = O.with_sections(_as_kind(spark, sf, "Gain", "Passthrough"))
    return rows.select(*KEYS, "kind", rounded(F.col("sos.b0"), 9).alias("b0"))


def pass_filters(spark, sf):
    """One pass filter per part; families, orders and sides vary."""
    key = F.col("p_partkey")
    family = F.element_at(F.array(*[F.lit(x) for x in ("BW", "LR", "BESP", "BESM3", "BESM6")]), (F.col("p_size") % 5 + 1).cast("int"))
    order = F.when(F.col("p_size") % 5 == 1, (key % 12 + 1) * 2).otherwise(key % 24 + 1)
    return table(spark, sf, "part").select(
        F.floor(key / 8).alias("filter_set_id"), (key % 8).alias("seq"), family.alias("family"),
        order.cast("int").alias("order"), F.when(key % 2 == 0, "low").otherwise("high").alias("side"),
        F.lit(1000).alias("fs"), (F.col("p_size") + 10).cast("double").alias("freq"), F.lit(0.5 ** 0.5).alias("q"),
    )


BESSEL_VALUES = ", ".join(
    f"('{f}', {o}, {s}, {'null' if q is None else repr(q)}::double, {m!r}::double)" for f, o, s, q, m in bessel_rows()
)
PASSES = f"""passes as (select p_partkey // 8 as filter_set_id, p_partkey % 8 as seq,
 (['BW','LR','BESP','BESM3','BESM6'])[p_size % 5 + 1] as family,
 cast(case when p_size % 5 = 1 then (p_partkey % 12 + 1) * 2 else p_partkey % 24 + 1 end as integer) as "order",
 case when p_partkey % 2 = 0 then 'low' else 'high' end as side, 1000 as fs, cast(p_size + 10 as double) as freq from part),
bessel(family, "order", sub, q, mult) as (values {BESSEL_VALUES}),
bw as (select *, case family when 'LR' then "order" // 2 else "order" end as m,
  case family when 'LR' then 2 else 1 end as twice from passes where family in ('BW','LR')),
bws as (select *, sub % ((m + 1) // 2) as s from bw, lateral (select unnest(range(twice * ((m + 1) // 2))) as sub)),
sections as (
 select filter_set_id, seq, side, family, "order", fs, cast(sub as integer) as sub, freq,
  case when m % 2 = 1 and s = 0 then null
       else 1/(2*cos(case when m % 2 = 1 then s*pi()/m else (2*s+1)*pi()/(2*m) end)) end as q from bws
 union all
 select filter_set_id, seq, side, p.family, p."order", fs, sub,
  case side when 'low' then freq*mult else freq/mult end as freq, q
 from passes p join bessel b on p.family = b.family and p."order" = b."order"),
secs as (select *, case side when 'low' then 'LowPass' else 'HighPass' end || case when q is null then '1' else '2' end as kind,
 1 as n, 0.0::double as gain from sections)
"""


@query("pass_filter_sections", f"with {PASSES}, {coef('secs')} select filter_set_id, seq, family, \"order\", side, sub, kind, "
       f"round(freq, 6) as freq, round(q, 6) as q, {COEFS} from coef")
def pass_filter_sections(spark, sf):
    rows = O.pass_sections(pass_filters(spark, sf))
    extra = ["family", "order", "side", "sub", "kind", rounded(F.col("freq")).alias("freq"), rounded(F.col("q")).alias("q")]
    return _coefs(O.with_sections(rows), *extra)


@query("resample_filters", sql_with("filters", extra="f2 as (select * replace (cast(48000 as integer) as fs) from filters),\n" + coef("f2"))
       + f"select filter_set_id, seq, fs, {COEFS} from coef")
def resample_filters(spark, sf):
    return _coefs(O.resample(filters(spark, sf), 48000), "fs")


SUMMED = W + RESPONSE.format(points=POINTS, keys="filter_set_id", src="coef")
WRAP = "ph - ceil((ph - 180)/360)*360"


@query("set_response", SUMMED + f"""select filter_set_id, cast(k as integer) as k, k*fs/(2.0*{POINTS}) as f,
 round(db, 6) + 0.0 as db, round({WRAP}, 4) + 0.0 as phase from
 (select filter_set_id, k, fs, sum(db) as db, sum(ph) + 0.0123 as ph from resp group by all)""")
def set_response(spark, sf):
    out = O.response(filters(spark, sf), POINTS)
    # A fixed turn of 0.0123 degrees keeps the compared phase off the wrap point.
    turned = biquad.wrap_degrees(F.col("phase") + 0.0123)
    return out.select("filter_set_id", F.col("k").cast("int").alias("k"), "f", rounded(F.col("db")).alias("db"),
                      rounded(turned, 4).alias("phase"))


@query("filter_and_set_response", SUMMED + f"""select filter_set_id, seq, cast(k as integer) as k,
 round(sum(db), 6) + 0.0 as db from resp group by grouping sets ((filter_set_id, k), (filter_set_id, seq, k))""")
def filter_and_set_response(spark, sf):
    out = O.response_per_filter(filters(spark, sf), POINTS)
    return out.select("filter_set_id", "seq", F.col("k").cast("int").alias("k"), rounded(F.col("db")).alias("db"))


@query("dc_group_delay", W + """select filter_set_id, round(sum(copies * ((b1+2*b2)/nullif(b0+b1+b2,0)
 - (a1+2*a2)/nullif(1+a1+a2,0))/fs*1000), 6) as delay_ms from coef group by 1""")
def dc_group_delay(spark, sf):
    out = O.dc_delay(filters(spark, sf))
    return out.select("filter_set_id", rounded(F.col("delay_ms")).alias("delay_ms"))


@query("shelf_slope", sql_with("filters", extra="g as (select *, pow(10.0::double, gain/40) + 1/pow(10.0::double, gain/40) as p from filters),\ns as (select *, 1/((1/(q*q) - 2)/p + 1) as slope from g)")
       + """select filter_set_id, seq, round(slope, 9) as slope, round(1/sqrt(p*(1/slope - 1) + 2), 9) as q,
 round(1/(-1.9975/p + 1), 9) as steepest, round(q*sqrt(2), 9) as device_q, round(q/sqrt(2), 9) as from_device_q from s""")
def shelf_slope(spark, sf):
    slope = biquad.shelf_slope(F.col("q"), F.col("gain"))
    q = F.col("q")
    return filters(spark, sf).select(
        *KEYS, rounded(slope, 9).alias("slope"), rounded(biquad.shelf_q(slope, F.col("gain")), 9).alias("q"),
        rounded(biquad.steepest_slope(F.col("gain")), 9).alias("steepest"),
        rounded(biquad.pass_q_to_device(q), 9).alias("device_q"), rounded(biquad.pass_q_from_device(q), 9).alias("from_device_q"),
    )


@query("biquad_count", W + "select filter_set_id, cast(sum(copies) as bigint) as biquads from coef group by 1")
def biquad_count(spark, sf):
    return O.biquad_count(filters(spark, sf))


@query("biquad_budget", W + """select filter_set_id, cast(sum(copies) as bigint) as biquads,
 cast(greatest(10 - sum(copies), 0) as bigint) as padding, cast(greatest(sum(copies) - 10, 0) as bigint) as excess
 from coef where kind <> 'AllPass' group by 1""")
def biquad_budget(spark, sf):
    return O.budget(filters(spark, sf), "hd")


@query("reduced_shelves", W + """, used as (select filter_set_id, sum(copies) as used from coef group by 1),
s as (select *, abs(gain*n) as weight from coef join used using (filter_set_id)
  where kind in ('LowShelf','HighShelf') and n > 1 and used > 6),
r as (select *, row_number() over (partition by filter_set_id order by -gain*n, n desc, seq) as rk,
  sum(weight) over (partition by filter_set_id) as total from s),
walk as (
 select filter_set_id, seq, rk, n, weight, total - weight as w_left, cast(used - 6 as bigint) as before,
  cast(least(case when total > 1e-9 then round_even(round(weight/total*(used - 6), 9), 0) else used - 6 end, n - 1) as bigint) as take from r where rk = 1
 union all
 select r.filter_set_id, r.seq, r.rk, r.n, r.weight, w.w_left - r.weight, w.before - w.take,
  cast(least(case when w.w_left > 1e-9 then round_even(round(r.weight/w.w_left*(w.before - w.take), 9), 0) else w.before - w.take end, r.n - 1) as bigint)
 from walk w join r on r.filter_set_id = w.filter_set_id and r.rk = w.rk + 1),
m as (select c.*, coalesce(take, 0) as take from coef c left join walk using (filter_set_id, seq)),
g as (select *, gain*n/(n - take) as ng from m),
p as (select *, pow(10.0::double, ng/40) + 1/pow(10.0::double, ng/40) as pn, pow(10.0::double, gain/40) + 1/pow(10.0::double, gain/40) as po from g),
sl as (select *, (1/((1/(q*q) - 2)/pn + 1) + 1/((1/(q*q) - 2)/po + 1))/2 as avg_s from p)
select filter_set_id, seq, kind, cast(n - take as integer) as n, cast(take as integer) as saved,
 round(case when take > 0 then ng else gain end, 6) + 0.0 as gain,
 round(case when take > 0 then 1/sqrt(pn*(1/avg_s - 1) + 2) else q end, 6) as q from sl""")
def reduced_shelves(spark, sf):
    out = O.reduce_shelves(filters(spark, sf), 6)
    return out.select(*KEYS, "kind", "n", "saved", rounded(F.col("gain")).alias("gain"), rounded(F.col("q")).alias("q"))


@query("upsert_filters", sql_with("filters") + """select filter_set_id, seq, kind, freq, q, case when seq = 3 then 1.5::double else gain end as gain, n
 from filters where seq <> 5 union all
 select filter_set_id, 8 as seq, kind, freq, q, 1.5::double as gain, n from filters where seq = 3""")
def upsert_filters(spark, sf):
    rows = filters(spark, sf)
    changed = rows.where(F.col("seq") == 3).withColumn("gain", F.lit(1.5))
    added = changed.withColumn("seq", F.lit(8).cast("long"))
    out = O.upsert(rows, changed.unionByName(added), rows.where(F.col("seq") == 5))
    return out.drop("fs")


@query("filter_order", sql_with("filters", extra="""k as (select *, cast(round(freq,2) as varchar) as ft, cast(abs(round(gain,3)) as varchar) as gt, gain < 0 as neg from filters),
t as (select *, lpad(ft, cast(greatest(5, length(ft)) as integer), '0') || case kind when 'AllPass' then '00000APF' else
 (case when round(gain,3) < 0 then '-' || lpad(gt, cast(greatest(4, length(gt)) as integer), '0') else lpad(gt, cast(greatest(5, length(gt)) as integer), '0') end)
 || case kind when 'PeakingEQ' then 'PEQ' when 'LowShelf' then 'LS' else 'HS' end end as sort_key from k)""")
       + """select filter_set_id, seq, sort_key, cast(row_number() over (partition by filter_set_id order by sort_key, seq) - 1 as bigint) as position from t""")
def filter_order(spark, sf):
    from lowtide.operators.ordering import with_position

    keyed = filters(spark, sf).select(*KEYS, O.sort_key(F.col("kind"), F.col("freq"), F.col("gain")).alias("sort_key"))
    return with_position(keyed, ["filter_set_id"], ["sort_key", "seq"], "position")


@query("device_flattened", W + """select filter_set_id, seq, cast(copy as integer) as copy, kind, freq, q, gain, cast(1 as integer) as n from coef,
 lateral (select unnest(range(1, copies + 1)) as copy) where kind <> 'AllPass'""")
def device_flattened(spark, sf):
    return O.flatten_for_device(filters(spark, sf)).drop("fs")


PATCH = """, bad as (select distinct filter_set_id from filters where kind = 'AllPass'),
ok as (select filter_set_id, seq, kind, freq, q, gain from filters where filter_set_id not in (select filter_set_id from bad)),
n as (select filter_set_id, max(seq) + 1 as n from ok group by 1),
al as (select * from ok union all select filter_set_id, cast(k as bigint), 'PeakingEQ', 100.0::double, 1.0::double, 0.0::double
  from n, lateral (select unnest(range(n, 16)) as k))
"""


@query("device_patch_ops", sql_with("filters") + PATCH + """select filter_set_id, seq as slot, 'replace' as op,
 '/peq/slots/' || seq || '/channels/' || filter_set_id || '/' || name as path, value from (
 select filter_set_id, seq, 'Fc' as name, round(freq, 2) as value from al union all
 select filter_set_id, seq, 'Q', q from al union all select filter_set_id, seq, 'gaindB', round(gain, 3) from al union all
 select filter_set_id, seq, 'FilterType', case kind when 'PeakingEQ' then 0.0::double when 'LowShelf' then 1.0::double else 2.0::double end from al)""")
def device_patch_ops(spark, sf):
    return O.device_ops(filters(spark, sf))


@query("device_unsupported", sql_with("filters") + "select filter_set_id, 'APF' as types from filters where kind = 'AllPass' group by 1")
def device_unsupported(spark, sf):
    return O.unsupported(filters(spark, sf)).withColumn("types", F.array_join("types", ","))


@query("device_slots", W + """, o as (select *, coalesce(sum(copies) over (partition by filter_set_id order by seq rows between unbounded preceding and 1 preceding)  , 0) as done,
 sum(copies) over (partition by filter_set_id) as total from coef where kind <> 'AllPass')
select filter_set_id, case when total <= 16 then cast(16 - total + done + copy - 1 as bigint) end as slot, freq, q, round(gain, 3) as gain,
 cast(case kind when 'PeakingEQ' then 0 when 'LowShelf' then 1 else 2 end as integer) as filter_type
 from o, lateral (select unnest(range(1, copies + 1)) as copy)""")
def device_slots(spark, sf):
    return O.slot_placement(filters(spark, sf))


@query("filter_difference", sql_with("filters") + """select filter_set_id, cast(seq as bigint) as seq,
 case when seq = 0 then 'extra' when seq = 7 then 'missing' when seq % 2 = 1 then 'changed' else 'same' end as status from filters""")
def filter_difference(spark, sf):
    rows = filters(spark, sf)
    nudged = rows.withColumn("q", F.when(F.col("seq") % 2 == 1, F.col("q") + 0.01).otherwise(F.col("q")))
    out = O.difference(rows.where(F.col("seq") != 0), nudged.where(F.col("seq") != 7))
    return out.select(*KEYS, "status")


@query("player_rows", sql_with("filters") + """select filter_set_id, seq, '1' as "Enabled",
 case kind when 'PeakingEQ' then '3' when 'LowShelf' then '10' when 'HighShelf' then '11' else '17' end as "Type", '12' as "Slope",
 format('{:.7g}', q) as "Q", format('{:.7g}', round(freq, 2)) as "Frequency",
 case kind when 'AllPass' then '0' else format('{:.7g}', round(gain, 3) + 0.0) end as "Gain", '5' as "Channels" from filters""")
def player_rows(spark, sf):
    return O.player_rows(filters(spark, sf), "5")


@query("player_pass_rows", f"with {PASSES}" + """, w as (select * from secs where not (family = 'BW' and "order" in (4, 6, 8)))
select filter_set_id, seq, cast(sub as integer) as sub, '1' as "Enabled", case side when 'low' then '1' else '2' end as "Type",
 case when q is null then '6' else '12' end as "Slope", round(cast(case when q is null then '1' else format('{:.12g}', q) end as double), 6) as "Q",
 round(freq, 2) as "Frequency", '0' as "Gain", 'L' as "Channels" from w
union all select filter_set_id, seq, 0, '1', case side when 'low' then '1' else '2' end, cast("order" * 6 as varchar), 0.707107::double,
 freq, '0', 'L' from passes where family = 'BW' and "order" in (4, 6, 8)""")
def player_pass_rows(spark, sf):
    out = O.player_passes(pass_filters(spark, sf), "L")
    return out.withColumn("Q", rounded(F.col("Q").cast("double"))).withColumn("Frequency", F.col("Frequency").cast("double"))


NUMBERED = """, o as (select *, coalesce(sum(copies) over (partition by filter_set_id order by seq rows between unbounded preceding and 1 preceding)  , 0) as done from coef),
num as (select *, done + copy as number from o, lateral (select unnest(range(1, copies + 1)) as copy))
"""


@query("equaliser_text", W + NUMBERED + """select filter_set_id, cast(number as bigint) as number,
 'Filter ' || cast(number as bigint) || ': ON ' || case kind when 'PeakingEQ' then 'PK' when 'LowShelf' then 'LSC' when 'HighShelf' then 'HSC' else 'AP' end
 || ' Fc ' || format('{:g}', round(freq,2)) || ' Hz' || case kind when 'AllPass' then '' else ' Gain ' || format('{:g}', round(gain,3) + 0.0) || ' dB' end
 || ' Q ' || cast(round(q, 4) as varchar) as line from num""")
def equaliser_text(spark, sf):
    return O.eq_text(filters(spark, sf))


REPORT = ("filters", "f96 as (select * replace (cast(96000 as integer) as fs) from filters),\n" + coef("f96"))
PAD = """, cnt as (select filter_set_id, sum(copies) as n from coef group by 1),
bq as (select filter_set_id, number, b0, b1, b2, a1, a2 from num union all
 select filter_set_id, k, 1.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from cnt, lateral (select unnest(range(cast(n as bigint) + 1, 25)) as k))
"""


@query("biquad_report_decimal", sql_with(REPORT[0], extra=REPORT[1]) + NUMBERED + PAD + """, dec as (select filter_set_id, number,
 [regexp_replace(cast(cast(round(x, 9) as decimal(38,9)) as varchar), '(\\.\\d+?)0*$', '\\1') for x in [b0, b1, b2, -a1 + 0.0, -a2 + 0.0]] as t from bq)
select filter_set_id, cast(number as bigint) as number, 'biquad' || cast(number as bigint) || chr(44) || chr(10) || 'b0=' || t[1] || chr(44) || chr(10) || 'b1=' || t[2]
 || chr(44) || chr(10) || 'b2=' || t[3] || chr(44) || chr(10) || 'a1=' || t[4] || chr(44) || chr(10) || 'a2=' || t[5] as text from dec""")
def biquad_report_decimal(spark, sf):
    return O.biquad_report(filters(spark, sf), 96000, 24, "decimal", device=True, places=9)


@query("biquad_report_ieee", sql_with(REPORT[0], extra=REPORT[1]) + NUMBERED + PAD + """, v as (select filter_set_id, number, k,
 cast(cast(([b0, b1, b2, -a1, -a2])[k] as float) as double) as x from bq, (select unnest(range(1, 6)) as k)),
e as (select *, abs(x) as ax, case when x = 0 then 0 else floor(log2(abs(x))) end as g from v),
e2 as (select *, case when x = 0 then 0 when pow(2.0::double, g) > ax then g - 1 when pow(2.0::double, g + 1) <= ax then g + 1 else g end as p from e),
bits as (select filter_set_id, number, k, lpad(lower(hex(cast(case when x = 0 then 0 else
 (case when x < 0 then 2147483648 else 0 end) + (p + 127) * 8388608 + (ax / pow(2.0::double, p) * 8388608 - 8388608) end as bigint))), 8, '0') as h from e2)
select filter_set_id, cast(number as bigint) as number, 'hex' || cast(number as bigint) || chr(44) || chr(10)
 || string_agg((['b0=','b1=','b2=','a1=','a2='])[k] || h, chr(44) || chr(10) order by k) as text from bits group by filter_set_id, number""")
def biquad_report_ieee(spark, sf):
    return O.biquad_report(filters(spark, sf), 96000, 24, "ieee", device=True)


@query("biquad_report_fixed", sql_with(REPORT[0], extra=REPORT[1]) + NUMBERED + PAD + """, v as (select filter_set_id, number, k,
 ([b0, b1, b2, -a1, -a2])[k] as x from bq, (select unnest(range(1, 6)) as k)),
h as (select filter_set_id, number, k, lpad(lower(hex(case when x < 0 then xor(cast(trunc(-x * 8388608) as bigint), 268435455) else cast(trunc(x * 8388608) as bigint) end)), 8, '0') as h from v)
select filter_set_id, cast(number as bigint) as number, 'hex' || cast(number as bigint) || chr(44) || chr(10)
 || string_agg((['b0=','b1=','b2=','a1=','a2='])[k] || h, chr(44) || chr(10) order by k) as text from h group by filter_set_id, number""")
def biquad_report_fixed(spark, sf):
    return O.biquad_report(filters(spark, sf), 96000, 24, "fixed", device=True)


@query("filter_summary", W + """, r as (select *, case kind when 'AllPass' then 0.0::double else round(gain, 3) end as g from coef)
select filter_set_id, seq, cast(round(freq, 2) as varchar) as freq, case when g = 0 then 'N/A' else format('{:+g}', g) end as gain,
 cast(round(q, 4) as varchar) as q, case kind when 'PeakingEQ' then 'PEQ' when 'LowShelf' then 'LS' when 'HighShelf' then 'HS' else 'APF' end
 || case when copies > 1 then ' x' || copies else '' end as type,
 case when g <> 0 and copies > 1 then format('{:+g}', g * copies) else '' end as total from r
union all select filter_set_id, null, '', format('{:+g}', -2.5::double), '', 'MV', '' from (select distinct filter_set_id from coef where filter_set_id % 3 = 0)""")
def filter_summary(spark, sf):
    rows = filters(spark, sf)
    db = F.when(F.col("filter_set_id") % 3 == 0, -2.5).otherwise(0.0)
    return O.summary_table(rows, rows.select("filter_set_id").distinct().withColumn("offset_db", db))


@query("set_cascades", W + """, r as (select filter_set_id, unnest([b0, b1, b2, a1, a2]) as c, unnest([0, 1, 2, 3, 4]) as k, seq, copy from coef, lateral (select unnest(range(copies)) as copy))
select filter_set_id, cast(row_number() over (partition by filter_set_id order by seq, copy, k) - 1 as integer) as at, round(c, 9) + 0.0 as c from r""")
def set_cascades(spark, sf):
    flat = O.cascades(filters(spark, sf))
    return flat.select("filter_set_id", F.posexplode("sos").alias("at", "c")).withColumn("c", rounded(F.col("c"), 9))
