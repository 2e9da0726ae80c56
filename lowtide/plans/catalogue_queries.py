"""Registered queries on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lowtide.functions.levels import rounded
from lowtide.operators import catalogue as G
from lowtide.plans.filter_queries import RESPONSE, coef
from lowtide.plans.registry import query
from lowtide.plans.tables import catalogue, episodes, filters, sql_with

W = sql_with("catalogue")
AS_OF = 1800000000


def entries(spark, sf):
    """The catalogue with derived columns."""
    df = catalogue(spark, sf)
    title = G.formatted_title(F.col("title"), F.col("content_type"), F.col("season"), F.lit(""))
    return df.withColumn("formatted_title", title).withColumn("mv_adjust", F.col("mv").try_cast("double"))


def with_filters(spark, sf):
    """Entries that own a set of (at most eight) filters."""
    each = F.struct(F.col("kind").alias("type"), "freq", "gain", "q")
    sets = filters(spark, sf).groupBy(F.col("filter_set_id").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("seq", each.alias("f"))))["f"].alias("filters")
    )
    return sets


SHOWN = ", e as (select *, case when content_type = 'TV' then title || ' ' || case when season = '' then '' else 'S' || season end else title end as formatted_title, cast(mv as double) as mv_adjust from catalogue)"


@query("catalogue_search", W + SHOWN + """ select idx, formatted_title || ' (' || author || ') (' || array_to_string(audio_types, ',') || ')' as label from e
 where year in (1990, 1995, 2001, 2017) and content_type = 'film' and contains(lower(title), 'ring') and author <> ''""")
def catalogue_search(spark, sf):
    found = G.search(entries(spark, sf), years=[1990, 1995, 2001, 2017], content_types=["film"], title=" RING ")
    return found.select("idx", G.label(found).alias("label"))


@query("catalogue_match_count", W + "select count(*) as matches from catalogue where contains(lower(title), 'widget') and author in ('Brand#2', 'Brand#17')")
def catalogue_match_count(spark, sf):
    found = G.search(entries(spark, sf), title="widget", authors=["Brand#2", "Brand#17"])
    return found.agg(F.count(F.lit(1)).alias("matches"))


@query("catalogue_matches", W + "select idx from catalogue where author in ('Brand#1', 'Brand#2', 'Brand#3') and year in (1985, 1990, 2000) and list_has_any(audio_types, ['ECONOMY', 'SMALL', 'LARGE'])")
def catalogue_matches(spark, sf):
    return G.matches(entries(spark, sf), ["Brand#1", "Brand#2", "Brand#3"], [1985, 1990, 2000], ["ECONOMY", "SMALL", "LARGE"]).select("idx")


@query("catalogue_year_range", W + "select idx, year from catalogue where year between 1990 and 1999")
def catalogue_year_range(spark, sf):
    return G.year_range(entries(spark, sf), 1990, 1999).select("idx", "year")


@query("catalogue_facets", W + """select 'year' as facet, cast(year as varchar) as value, count(*) as entries from catalogue group by all
 union all select 'content_type', content_type, count(*) from catalogue group by all
 union all select 'min_year', cast(min(year) as varchar), count(*) from catalogue union all select 'max_year', cast(max(year) as varchar), count(*) from catalogue""")
def catalogue_facets(spark, sf):
    return G.facets(entries(spark, sf))


@query("catalogue_years", W + "select distinct year from catalogue order by year desc")
def catalogue_years(spark, sf):
    return G.years_descending(entries(spark, sf))


@query("catalogue_content_types", W + "select distinct content_type from catalogue where contains(lower(content_type), 't') order by 1")
def catalogue_content_types(spark, sf):
    return G.content_types(entries(spark, sf), "T")


@query("catalogue_lookup", W + "select idx, title from catalogue join (select distinct cast(l_partkey as varchar) as idx from lineitem) using (idx)")
def catalogue_lookup(spark, sf):
    from lowtide.plans.tables import table

    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("idx")).distinct()
    return G.lookup(entries(spark, sf), wanted).select("idx", "title")


@query("catalogue_freshness", W + f"""select idx, case when created_at >= {AS_OF} - 1209600 then 'Fresh' when updated_at >= {AS_OF} - 1209600 then 'Updated' else 'Stale' end as freshness from catalogue""")
def catalogue_freshness(spark, sf):
    return entries(spark, sf).select("idx", G.freshness(AS_OF).alias("freshness"))


@query("formatted_titles", W + SHOWN + " select idx, formatted_title from e")
def formatted_titles(spark, sf):
    return entries(spark, sf).select("idx", "formatted_title")


@query("episode_runs", sql_with("episodes") + """, d as (select distinct title, ep from episodes), g as (select title, ep, ep - row_number() over (partition by title order by ep) as island from d),
r as (select title, island, min(ep) as a, max(ep) as b from g group by all)
select title, 'show S1E' || string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ', ' order by a) as formatted_title from r group by 1""")
def episode_runs(spark, sf):
    sets = episodes(spark, sf).groupBy("title").agg(F.array_sort(F.collect_set("ep")).cast("array<string>").alias("eps"))
    shown = G.formatted_title(F.lit("show"), F.lit("TV"), F.lit("1"), F.array_join("eps", ","))
    return sets.select("title", shown.alias("formatted_title"))


@query("catalogue_filters", sql_with("filters") + "select filter_set_id, seq, kind, freq, q, gain, cast(1 as integer) as n from filters where kind <> 'AllPass'")
def catalogue_filters(spark, sf):
    return G.expand_filters(with_filters(spark, sf))


@query("catalogue_unknown_filters", sql_with("filters") + "select filter_set_id as idx, cast(seq as integer) as seq, 'AllPass' as type from filters where kind = 'AllPass'")
def catalogue_unknown_filters(spark, sf):
    return G.unknown_filters(with_filters(spark, sf))


@query("catalogue_responses", sql_with("filters", extra="one as (select * replace (1 as n) from filters where kind <> 'AllPass'),\n" + coef("one"))
       + RESPONSE.format(points=64, keys="filter_set_id", src="coef") + "select filter_set_id, cast(k as integer) as k, round(sum(db) + 87.4, 6) + 0.0 as db from resp group by all")
def catalogue_responses(spark, sf):
    out = G.responses(with_filters(spark, sf), 64, level_db=87.4)
    return out.select("filter_set_id", F.col("k").cast("int").alias("k"), rounded(F.col("db")).alias("db"))


@query("catalogue_search_json", W + SHOWN + """ select idx, '{"id":"' || idx || '","title":"' || title || '","year":' || year || ',"audioTypes":["' || audio_types[1] || '"],"contentType":"' || content_type
 || '","author":"' || author || '","created_at":' || created_at || ',"updated_at":' || updated_at || ',"formattedTitle":"' || formatted_title || '"'
 || case when season = '' then '' else ',"season":"' || season || '"' end || case when mv_adjust = 0 then '' else ',"mvAdjust":' || mv_adjust end
 || case when edition = '' then '' else ',"edition":"' || edition || '"' end || ',"note":"' || note || '"'
 || case when language = '' then '' else ',"language":"' || language || '"' end || ',"source":"' || source || '"}' as doc from e""")
def catalogue_search_json(spark, sf):
    rows = entries(spark, sf)
    return rows.select("idx", G.search_json(rows).alias("doc"))


PATHS = SHOWN + """, nm as (select *, replace(replace(formatted_title || case when edition = '' then '' else '_' || edition end || '_' || year || '_' || audio_types[1], '/', '_'), '.', '') as name from e),
g as (select *, count(*) over w as n, count(distinct source) over w as us, count(distinct mv_adjust) over w as um, count(distinct note) over w as un, count(distinct language) over w as ul,
 row_number() over (partition by author, name order by cast(idx as bigint)) - 1 as nth from nm window w as (partition by author, name)),
o as (select *, case when n = 1 then '' when us = n then '_' || source when um = n then '_MV ' || mv_adjust when un = n then '_' || note when ul = n then '_' || language else '_' || nth end as tail,
 case when n > 1 and us <> n and um <> n and un <> n and ul <> n then 'Duplicate entry' end as problem from g)
select idx, author, content_type || '/' || author || '/' || upper(formatted_title[1]) || '/' || name || tail || '.xml' as path, problem from o"""


@query("catalogue_output_paths", W + PATHS)
def catalogue_output_paths(spark, sf):
    return G.output_paths(entries(spark, sf), ".xml")


@query("catalogue_duplicate_paths", W + PATHS.replace("|| '_' || year || '_' || audio_types[1]", "|| '_' || audio_types[1]"))
def catalogue_duplicate_paths(spark, sf):
    return G.output_paths(entries(spark, sf).withColumn("year", F.lit(0)), ".xml")


@query("catalogue_last_updated", W + "select author, max(updated_at) as last_updated from catalogue group by 1")
def catalogue_last_updated(spark, sf):
    return G.last_updated(entries(spark, sf), ["author"])


@query("publish_status", sql_with("filters") + """, s as (select filter_set_id, case when bool_or(kind = 'AllPass') then 'failed' when count(*) filter (kind <> 'AllPass') > 6 then 'optimised' else 'ok' end as status
 from filters group by 1) select status, count(*) as entries from s group by 1""")
def publish_status(spark, sf):
    return G.status_report(G.publish_status(_filter_sets(spark, sf), 6))


def _filter_sets(spark, sf):
    each = F.struct(F.col("kind").alias("type"), "freq", "gain", "q")
    return filters(spark, sf).groupBy(F.col("filter_set_id").alias("idx")).agg(F.collect_list(each).alias("filters"))


@query("publish_status_unmerged", sql_with("filters") + """, s as (select filter_set_id as idx, bool_or(kind = 'AllPass') as bad, count(*) filter (kind <> 'AllPass') as n from filters group by 1)
select idx, case when bad or n > 6 then 'failed' else 'ok' end as status, cast(case when not bad and n > 6 then n - 6 end as integer) as excess from s""")
def publish_status_unmerged(spark, sf):
    """The same where shelves may not be merged: too many filters is a failure, with the number to remove."""
    return G.publish_status(_filter_sets(spark, sf), 6, optimise=False)


@query("publish_names", W + """select idx, replace(title || ' (' || year || ')' || case when season = '' then '' else ' (Season ' || season || ')' end
 || case when edition = '' then '' else ' (' || edition || ')' end || case when source = 'Disc' then '' else ' (' || source || ')' end
 || case when cast(mv as double) = 0 then '' else ' (' || format('{:+.1f}', cast(mv as double)) || ' gain)' end || ' BEQ ' || audio_types[1], ':', '-') as name,
 regexp_replace(lower(trim('The ' || title)), '^the ', '') as sort_title from catalogue""")
def publish_names(spark, sf):
    rows = entries(spark, sf).withColumn("offset_db", F.col("mv_adjust"))
    return rows.select("idx", G.publish_name(rows).alias("name"), G.sort_title(F.concat(F.lit("The "), F.col("title"))).alias("sort_title"))


@query("metadata_completeness", W + """select idx, length(t) > 0 as title_ok, y <> 0 as year_ok, true as audio_ok, length(t) > 0 and y <> 0 as ok from
 (select idx, case when author = 'Brand#3' then '' else title end as t, case when year = 1999 then 0 else year end as y from catalogue)""")
def metadata_completeness(spark, sf):
    rows = entries(spark, sf).withColumn("title", F.when(F.col("author") == "Brand#3", "").otherwise(F.col("title")))
    return G.completeness(rows.withColumn("year", F.when(F.col("year") == 1999, 0).otherwise(F.col("year"))))


@query("catalogue_upsert", W + """, inc as (select idx as digest, title || ' v2' as title, updated_at + (cast(idx as bigint) % 3 - 1) * 1000 as updated_at from catalogue where author = 'Brand#2'
 union all select 'new-' || idx, title, updated_at from catalogue where author = 'Brand#5')
select coalesce(c.idx, i.digest) as digest, case when c.idx is null or i.updated_at > c.updated_at then i.title else c.title end as title, greatest(c.updated_at, i.updated_at) as updated_at
 from catalogue c full join inc i on c.idx = i.digest""")
def catalogue_upsert(spark, sf):
    rows = entries(spark, sf)
    now = rows.select(F.col("idx").alias("digest"), "title", "updated_at")
    n = F.col("idx").cast("long")
    changed = rows.where("author = 'Brand#2'").select(
        F.col("idx").alias("digest"), F.concat("title", F.lit(" v2")).alias("title"), (F.col("updated_at") + (n % 3 - 1) * 1000).alias("updated_at")
    )
    new = rows.where("author = 'Brand#5'").select(F.concat(F.lit("new-"), F.col("idx")).alias("digest"), "title", "updated_at")
    return G.upsert(now, changed.unionByName(new))
