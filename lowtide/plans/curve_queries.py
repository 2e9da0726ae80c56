"""Registered queries on frequency curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions import bands
from lowtide.functions.levels import amplitude_from_db, power_from_db, rounded
from lowtide.operators import curves as C
from lowtide.operators import stats as A
from lowtide.plans.registry import query
from lowtide.plans.tables import channel_samples, curves, sql_with, table

KEY = ["curve_id"]
W = sql_with("curves")


def _out(df, places=6):
    return df.select(*KEY, rounded(F.col("f"), 9).alias("f"), rounded(F.col("db"), places).alias("db"))


GRID = """, knots as (select *, lead(f) over w as f1, lead(db) over w as y1 from {src} window w as (partition by curve_id order by f)),
grid as ({grid}),
{name} as (select g.curve_id, g.f, case when k.f1 is null then k.db else k.db + (k.y1 - k.db)*(g.f - k.f)/(k.f1 - k.f) end as db
 from grid g asof join knots k on g.curve_id = k.curve_id and g.f >= k.f)"""


def own_grid(spark, sf):
    """Seventy points per curve that fall between and on its own."""
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("curve_id"))
    return ids.select("curve_id", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("j")).select(
        "curve_id", (F.col("j") * 3.5 + 4.5).alias("f")
    )


SQL_GRID = "select vec_id as curve_id, j*3.5::double + 4.5::double as f from embeddings, (select unnest(range(70)) as j)"


@query("interpolate_linear", W + GRID.format(src="curves", grid=SQL_GRID, name="o") + " select curve_id, f, round(db, 6) + 0.0 as db from o")
def interpolate_linear(spark, sf):
    return _out(C.interpolate(curves(spark, sf), own_grid(spark, sf), KEY, smooth=False))


# Monotone cubic: weighted harmonic mean inside, shape-preserving three-point ends.
PCHIP = """, d as (select *, f1 - f as h, (y1 - db)/(f1 - f) as m from (select *, lead(f) over w as f1, lead(db) over w as y1 from {src} window w as (partition by curve_id order by f))),
n as (select *, lag(h) over w as hp, lag(m) over w as mp, lead(h) over w as hn, lead(m) over w as mn, lag(h, 2) over w as hpp, lag(m, 2) over w as mpp from d window w as (partition by curve_id order by f)),
e as (select *, ((2*h + hn)*m - h*mn)/(h + hn) as e0, ((2*hp + hpp)*mp - hp*mpp)/(hp + hpp) as e1 from n),
sl as (select *, case when mp is null then case when sign(e0) <> sign(m) then 0.0 when sign(m) <> sign(mn) and abs(e0) > abs(3*m) then 3*m else e0 end
 when m is null then case when sign(e1) <> sign(mp) then 0.0 when sign(mp) <> sign(mpp) and abs(e1) > abs(3*mp) then 3*mp else e1 end
 when m*mp <= 0 then 0.0 else 3*(h + hp)/((2*h + hp)/mp + (h + 2*hp)/m) end as s0 from e),
knots as (select *, lead(s0) over (partition by curve_id order by f) as s1 from sl),
grid as ({grid}),
{name} as (select curve_id, f, case when h is null then db when t = 0 then db else db*(1+2*t)*(1-t)*(1-t) + s0*h*t*(1-t)*(1-t) + y1*t*t*(3-2*t) + s1*h*t*t*(t-1) end as db
 from (select g.curve_id, g.f, k.db, k.y1, k.s0, k.s1, k.h, (g.f - k.f)/k.h as t from grid g asof join knots k on g.curve_id = k.curve_id and g.f >= k.f))"""


@query("interpolate_smooth", W + PCHIP.format(src="curves", grid=SQL_GRID, name="o") + " select curve_id, f, round(db, 6) + 0.0 as db from o")
def interpolate_smooth(spark, sf):
    return _out(C.interpolate(curves(spark, sf), own_grid(spark, sf), KEY))


@query("rescale_curve", W + PCHIP.format(src="curves", name="o", grid="select vec_id as curve_id, 4.0::double + j*((256.0::double - 4)/100) as f from embeddings, (select unnest(range(100)) as j)")
       + " select curve_id, round(f, 9) as f, round(db, 6) + 0.0 as db from o")
def rescale_curve(spark, sf):
    return _out(C.rescale(curves(spark, sf), KEY, points=100))


def target_curves(spark, sf):
    """A coarser curve per key with a shorter range, made from the given one."""
    rows = curves(spark, sf).where((F.col("k") % 2 == 0) & (F.col("f") < 200))
    return rows.select("curve_id", "f", (F.col("db") * 0.5 + F.col("k") * 0.1).alias("db"))


TARGET = ", target as (select curve_id, f, db*0.5::double + k*0.1::double as db from curves where k % 2 = 0 and f < 200)"


@query("normalise_curve", W + TARGET + GRID.format(src="target", name="o", grid="select curve_id, f from curves where f <= (select max(f) from target)")
       + " select c.curve_id, c.f, round(c.db - o.db, 6) + 0.0 as db from curves c join o on c.curve_id = o.curve_id and c.f = o.f")
def normalise_curve(spark, sf):
    return _out(C.normalise(curves(spark, sf), target_curves(spark, sf), KEY, smooth=False))


# A response point lies between two points of the target, which are two places apart, or beyond its last one.
@query("filtered_curve", W + """, t as (select *, case when k % 2 = 0 and f < 200 then db*0.5::double + k*0.1::double end as t from curves),
u as (select *, lag(t) over w as a, lead(t) over w as b, last_value(t ignore nulls) over (w rows between unbounded preceding and current row) as z from t window w as (partition by curve_id order by k))
select curve_id, f, round(db + case when t is not null then t when b is not null then a + (b - a)/2 else z end, 6) + 0.0 as db from u""")
def filtered_curve(spark, sf):
    return _out(C.apply_filter(curves(spark, sf), target_curves(spark, sf), KEY, smooth=False))


BAND_SQL = """case when b % 2 = 1 then cast(round_even(b*ln({f}/1000)/ln(pow(10, 0.3)), 0) as integer)
 else cast(trunc(round_even(2*b*ln({f}/1000)/ln(pow(10, 0.3)) - 1, 0)/2) as integer) end"""
CENTRE_SQL = "case when b % 2 = 1 then 1000*pow(pow(10, 0.3), n/b) else 1000*pow(pow(10, 0.3), (2*n+1)/(2.0*b)) end"
OCTAVES = f""", fr as (select unnest([1, 2, 3, 6, 12, 24]) as b),
lim as (select vec_id as curve_id, b, {BAND_SQL.format(f="(case when b < 12 then 5.0 else 10.0 end)")} as n0, {BAND_SQL.format(f="256.0")} as n1 from embeddings, fr),
bd as (select *, c*pow(pow(10, 0.3), -0.5/b) as lo, c*pow(pow(10, 0.3), 0.5/b) as hi from (select *, {CENTRE_SQL} as c from (select curve_id, b, unnest(range(n0, n1 + 1)) as n from lim))),
s as (select bd.curve_id, b, n, c, coalesce(sum(sqrt(pow(10.0, 0.1*db))), 0) as a from bd left join curves k on k.curve_id = bd.curve_id and k.f > lo and k.f <= hi group by all),
l as (select *, 10*log10(greatest(1e-20::double, a*a)) as d from s)
"""


@query("octave_smoothing", W + OCTAVES + """select curve_id, cast(b as integer) as fraction, round(c, 6) as f,
 round(greatest(d, max(d) over (partition by curve_id, b) - 80), 5) + 0.0 as db from l""")
def octave_smoothing(spark, sf):
    out = C.smooth_octaves(curves(spark, sf), KEY)
    return out.select(*KEY, "fraction", rounded(F.col("f")).alias("f"), rounded(F.col("db"), 5).alias("db"))


LIMITS = """lim as (select p_partkey, ([1, 2, 3, 6, 12, 24])[p_partkey % 6 + 1] as b, cast(p_size + 4 as double) as f0, cast(p_size * 30 + 100 as double) as f1 from part),
r as (select p_partkey, b, n, {c} as center from (select p_partkey, b, unnest(range({n0}, {n1} + 1)) as n from lim))""".format(
    c=CENTRE_SQL, n0=BAND_SQL.format(f="f0"), n1=BAND_SQL.format(f="f1"))


@query("octave_bands", "with " + LIMITS + """ select p_partkey, cast(b as integer) as fraction, cast(n as integer) as band, round(center, 6) as center,
 round(center*pow(pow(10, 0.3), -0.5/b), 6) as lower, round(center*pow(pow(10, 0.3), 0.5/b), 6) as upper from r""")
def octave_bands(spark, sf):
    out = C.band_table(_limits(spark, sf), ["p_partkey"])
    return out.select("p_partkey", "fraction", "band", *[rounded(F.col(c)).alias(c) for c in ("center", "lower", "upper")])


def _limits(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(b) for b in C.FRACTIONS]), (key % 6 + 1).cast("int")).alias("fraction"),
        (F.col("p_size") + 4).cast("double").alias("f_start"), (F.col("p_size") * 30 + 100).cast("double").alias("f_stop"),
    )


THIRDS = "[10, 12.5, 16, 20, 25, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000]"


@query("nominal_frequencies", "with " + LIMITS + f""", e as (select *, pow(10, floor(log10(center))) as dec, cast({THIRDS} as double[]) as t from r)
select p_partkey, cast(b as integer) as fraction, cast(n as integer) as band, round(case
 when b = 3 and n >= -20 then t[n + 21] when b = 3 then t[n + 31]/10
 when b = 1 and n >= -6 then t[3*(n + 6) + 3] when b = 1 then t[3]/pow(2, -6 - n)
 when b = 2 or floor(center/dec) < 5 then round(center/dec*100, 0)/100*dec
 else round(center/dec*10, 0)/10*dec end, 6) as nominal from e""")
def nominal_frequencies(spark, sf):
    out = C.band_table(_limits(spark, sf), ["p_partkey"])
    return out.select("p_partkey", "fraction", "band", rounded(F.col("nominal")).alias("nominal"))


# Closed form of the five-point quadratic fit: inner weights and end rows.
@query("polynomial_smoothing", W + """, a as (select curve_id, list(db order by f) as y, list(f order by f) as x from curves group by 1),
p as (select curve_id, x, y, unnest(range(1, 65)) as j from a)
select curve_id, x[j] as f, round(case
 when j = 1 then (31*y[1] + 9*y[2] - 3*y[3] - 5*y[4] + 3*y[5])/35 when j = 2 then (9*y[1] + 13*y[2] + 12*y[3] + 6*y[4] - 5*y[5])/35
 when j = 64 then (31*y[64] + 9*y[63] - 3*y[62] - 5*y[61] + 3*y[60])/35 when j = 63 then (9*y[64] + 13*y[63] + 12*y[62] + 6*y[61] - 5*y[60])/35
 else (-3*y[j-2] + 12*y[j-1] + 17*y[j] + 12*y[j+1] - 3*y[j+2])/35 end, 6) + 0.0 as db from p""")
def polynomial_smoothing(spark, sf):
    return _out(C.smooth_polynomial(curves(spark, sf), KEY, "SG/5/2"))


@query("equal_energy_tilt", W + "select curve_id, f, round(db + 10*log10(8.0 + (256.0 - 8.0)*k/63), 6) + 0.0 as db from curves")
def equal_energy_tilt(spark, sf):
    return _out(C.equal_energy(curves(spark, sf), KEY))


@query("magnitude_phase", W + """, z as (select curve_id, f, db/40 as re, lead(db, 1, 0.0) over (partition by curve_id order by k)/40 as im from curves)
select curve_id, f, round(20*log10(greatest(sqrt(re*re + im*im)*2, 1e-7)), 6) + 0.0 as db, round(degrees(atan2(im, re)), 5) + 0.0 as degrees from z""")
def magnitude_phase(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("curve_id").orderBy("k")
    z = curves(spark, sf).select(
        "curve_id", "f", (F.col("db") / 40.0).alias("re"), (F.lead("db", 1, 0.0).over(w) / 40.0).alias("im")
    )
    out = C.magnitude_phase(z, scale=2.0)
    return out.select(*KEY, "f", rounded(F.col("db")).alias("db"), rounded(F.col("degrees"), 5).alias("degrees"))


@query("db_conversions", W + "select curve_id, f, round(pow(10.0, db/10), 7) as power, round(sqrt(pow(10.0, db/10)), 7) as amplitude from curves")
def db_conversions(spark, sf):
    db = F.col("db")
    return curves(spark, sf).select(*KEY, "f", rounded(power_from_db(db), 7).alias("power"), rounded(amplitude_from_db(db), 7).alias("amplitude"))


NAMES = "select vec_id || '_' || (['avg', 'peak', 'median'])[vec_id % 3 + 1] || (case when vec_id % 2 = 0 then '-filtered' else '' end) as name from embeddings"


@query("curve_name_filter", f"select name from ({NAMES}) where regexp_matches(name, '^.*_(avg|median)-filtered$')")
def curve_name_filter(spark, sf):
    v = F.col("vec_id")
    kind = F.element_at(F.array(F.lit("avg"), F.lit("peak"), F.lit("median")), (v % 3 + 1).cast("int"))
    tail = F.when(v % 2 == 0, "-filtered").otherwise("")
    names = table(spark, sf, "embeddings").select(F.concat(v.cast("string"), F.lit("_"), kind, tail).alias("name"))
    return C.choose(names, ["avg", "median"], filtered=True)


@query("value_at_frequency", W + GRID.format(src="curves", name="o", grid="select vec_id as curve_id, 4 + floor(90.3::double - 4) as f from embeddings")
       + " select curve_id, f, round(db, 3) + 0.0 as db from o")
def value_at_frequency(spark, sf):
    out = C.value_at(curves(spark, sf), KEY, 90.3)
    return out.withColumn("db", F.col("db") + 0.0)


@query("band_level_range", W + "select curve_id, cast(floor(min(db)) as bigint) as min_db, cast(ceil(max(db)) as bigint) as max_db from curves where f >= 20 and f < 120 group by 1")
def band_level_range(spark, sf):
    return C.level_range(curves(spark, sf), KEY, 20, 120)


@query("crossover_metrics", W + """, b as (select curve_id, f, db - f/10 as lp, db*0.5 - 30 + f/10 as hp from curves)
select curve_id, coalesce(min(f) filter (hp >= lp), min(f)) as fc,
 round(coalesce(min_by(lp, f) filter (f > 80), min_by(lp, f)) - coalesce(min_by(lp, f) filter (f > 160), min_by(lp, f)), 6) + 0.0 as lp_slope,
 round(coalesce(min_by(hp, f) filter (f > 5), min_by(hp, f)) - coalesce(min_by(hp, f) filter (f > 2.5), min_by(hp, f)), 6) + 0.0 as hp_slope from b group by 1""")
def crossover_metrics(spark, sf):
    rows = curves(spark, sf)
    low = rows.withColumn("db", F.col("db") - F.col("f") / 10.0)
    high = rows.withColumn("db", F.col("db") * 0.5 - 30.0 + F.col("f") / 10.0)
    out = C.crossover(low, high, KEY, 20.0)
    return out.select(*KEY, "fc", rounded(F.col("lp_slope")).alias("lp_slope"), rounded(F.col("hp_slope")).alias("hp_slope"))


@query("impulse_display", sql_with("channel_samples") + """, n as (select title, ch, (max(i)+1)/64.0::double as s from channel_samples group by all),
t as (select title, max(abs(v)) as top from channel_samples group by 1)
select title, ch, i, round((i/64.0::double - s/2)*1000, 6) + 0.0 as t_ms, round(v*100/top, 6) + 0.0 as percent from channel_samples join n using (title, ch) join t using (title)""")
def impulse_display(spark, sf):
    out = C.impulse_display(channel_samples(spark, sf), ["title"], ["title", "ch"])
    return out.select("title", "ch", "i", rounded(F.col("t_ms")).alias("t_ms"), rounded(F.col("percent")).alias("percent"))


@query("curve_equality", W + """select curve_id, bool_and(abs(d) <= 1e-5 + 1e-5*abs(db + d)) as equal from
 (select *, case when curve_id % 5 = 0 and k = 7 then 0.01::double else 1e-7::double end as d from curves) group by 1""")
def curve_equality(spark, sf):
    rows = curves(spark, sf)
    nudge = F.when((F.col("curve_id") % 5 == 0) & (F.col("k") == 7), 0.01).otherwise(1e-7)
    return C.nearly_equal(rows, rows.withColumn("db", F.col("db") + nudge), KEY)


EXT = """, top as (select curve_id, max(db) as peak_db, arg_max(f, (db, -f)) as peak_f from curves group by 1),
ext as (select c.curve_id, peak_f, peak_db, min(f) as low_f from curves c join top t on c.curve_id = t.curve_id where db >= peak_db - 4.5 group by all)"""


@query("low_frequency_extension", W + EXT + " select curve_id, peak_f, round(peak_db, 6) + 0.0 as peak_db, low_f, round(peak_db - 4.5, 6) + 0.0 as low_db from ext")
def low_frequency_extension(spark, sf):
    out = A.extension(curves(spark, sf), KEY, -4.5)
    return out.select(*KEY, "peak_f", rounded(F.col("peak_db")).alias("peak_db"), "low_f", rounded(F.col("low_db")).alias("low_db"))


@query("extension_rating", W + EXT + """, top2 as (select curve_id, max(db) as peak_db, arg_max(f, (db, -f)) as peak_f from (select * replace (db - f*0.02::double as db) from curves) group by 1),
ext2 as (select c.curve_id, peak_f, min(f) as low_f from (select * replace (db - f*0.02::double as db) from curves) c join top2 t on c.curve_id = t.curve_id where db >= peak_db - 4.5 group by all),
b as (select e.curve_id, e.peak_f > a.peak_f or (e.peak_f = a.peak_f and e.low_f <= a.low_f) as use_peak, e.low_f as pl, a.low_f as al from ext e join ext2 a using (curve_id)),
r as (select curve_id, case when use_peak then 'Peak' else 'Average' end as source, case when use_peak then pl else al end as low_f from b)
select *, cast(case when low_f < 10 then 5 when low_f < 15 then 4 when low_f < 20 then 3 when low_f < 25 then 2 else 1 end as integer) as rating from r""")
def extension_rating(spark, sf):
    rows = curves(spark, sf)
    peak = A.extension(rows, KEY, -4.5)
    avg = A.extension(rows.withColumn("db", F.col("db") - F.col("f") * 0.02), KEY, -4.5)
    return A.extension_rating(peak, avg, KEY)


@query("band_of_frequency", W + """select curve_id, f, cast(3 as integer) as fraction, cast(ceil(3*ln(f/1000)/ln(pow(10, 0.3)) - 0.5) as integer) as band from curves""")
def band_of_frequency(spark, sf):
    fraction = F.lit(3)
    return curves(spark, sf).select(*KEY, "f", fraction.alias("fraction"), bands.holding(F.col("f"), fraction).alias("band"))
