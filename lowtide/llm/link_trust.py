"""URL filters: ruled prefixes, and trust and distrust spread over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowtide.llm.columns import keep_columns, put_back
from lowtide.llm.registry import query, table
from lowtide.session import materialise

#: (verdict, host and path prefix) as given for the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
#: The walks end when no more than this part of the seeds' mass still walks and no further host has been reached.
LEFT = 1e-6
#: Steps between two written tables, after which that is looked at.
CUT_EVERY = 6
#: A host is blocked where more than this share of its score is distrust.
BLOCK_SHARE = 0.75
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
HREF = r"""(?i)\shref\s*=\s*["']?\s*([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str = "url") -> dict[str, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.coalesce(F.col(url), F.lit(""))
    return {"host": _lower(F.regexp_extract(after, HOST, 1)), "path": F.regexp_extract(after, PATH, 1)}


def matched_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, path = text.partition("/")
        fits = (F.col("host") == name) | F.col("host").endswith("." + name)
        fits &= F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted before the shuffle; a relative link stays on its host."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("_link"))
    other = _lower(F.regexp_extract("_link", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    inside = ~F.col("_link").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    dst = F.when(other != "", other).when(inside, F.col("host"))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, left: float = LEFT) -> DataFrame:
    """(way, host, score): personalised PageRank as the sum of damped walks from the seeds.

    ``edges`` (way, src, dst, w) hold one graph for each way of walking, weights out of a host adding up to 1; ``seeds``
    (way, host, mass). Mass that meets a host without links ends there. What stays on a host by links to itself, round
    after round, is summed at once as a geometric series; then steps lead from host to host only. They go on until at
    most ``left`` of the mass is walking and no host was reached that had not been before, however long the paths are.
    A host's score so far travels along a loop of its own, so that a step reads the one before it once.
    """
    hosts = edges.select("way", "src").unionByName(edges.select("way", F.col("dst").alias("src")))
    hosts = hosts.unionByName(seeds.select("way", F.col("host").alias("src"))).distinct()
    stays = edges.where("src = dst").select("way", "src", (1 / (1 - F.col("w") * damping)).alias("rounds"))
    hosts = materialise(hosts.join(stays, ["way", "src"], "left").select("way", "src", F.coalesce("rounds", F.lit(1.0)).alias("rounds")), "hosts")
    out = edges.where("src <> dst").join(hosts, ["way", "src"]).select("way", "src", "dst", (F.col("w") * damping * F.col("rounds")).alias("w"), F.lit(0.0).alias("keep"))
    own = hosts.select("way", "src", F.col("src").alias("dst"), F.lit(0.0).alias("w"), F.lit(1.0).alias("keep"))
    moves = materialise(out.unionByName(own), "moves")
    # x has just come to the host; score holds what came before.
    state = seeds.select("way", F.col("host").alias("src"), (F.col("mass") * (1 - damping)).alias("x"), F.lit(0.0).alias("score"))
    known = -1
    while True:
        for _ in range(CUT_EVERY):
            state = (
                state.join(moves, ["way", "src"])
                .groupBy("way", F.col("dst").alias("src"))
                .agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum((F.col("score") + F.col("x")) * F.col("keep")).alias("score"))
            )
        state = materialise(state, "walk")
        now = state.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.count_if((F.col("score") > 0) | (F.col("x") > 0)).alias("n")).first()
        if now.x <= left * (1 - damping) and now.n == known:
            break
        if now.x == 0:
            break
        known = now.n
    total = (F.col("score") + F.col("x")) * F.col("rounds")
    return state.join(hosts, ["way", "src"]).select("way", F.col("src").alias("host"), total.alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, share: float = BLOCK_SHARE) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` to pages (page_id, url, html).

    A page that a rule fits has the rule's verdict. For the others, hosts are judged: trust walks along the links from
    hosts with allowed pages, distrust walks against the links from hosts with blocked pages (who links to a blocked
    host is suspect). A seed's mass is the share of its ruled pages with that verdict; both masses add up to 1. A host
    is blocked where distrust makes up more than ``share`` of its two scores.

    A null url or one without ``://`` has an empty host and path, takes no part in the graph and is allowed, as is a host
    that no walk reaches. Null pages have no links. Repeated rows are judged alike; more links from repeated rows weigh
    more. An empty table gives no rows. Other columns pass through, whatever they are called; those of the added names
    are replaced.
    """
    rule, verdict = matched_rule(rules)
    pages, names = keep_columns(pages, "page_id", "url", "html")
    named = pages.withColumns(url_parts()).withColumns({"rule": rule, "_says": verdict})
    seen = named.where("host <> '' AND _says IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("_says") == "allow").alias("allow"), F.count_if(F.col("_says") == "block").alias("block")
    )
    seen = materialise(seen, "seeds")
    share_of = lambda c: F.col(c) / (F.col("allow") + F.col("block"))
    sums = seen.agg(F.sum(share_of("allow")).alias("allow"), F.sum(share_of("block")).alias("block")).first()
    ways = [("trust", "allow", sums.allow or 1.0), ("distrust", "block", sums.block or 1.0)]
    seeds = [seen.where(F.col(c) > 0).select(F.lit(w).alias("way"), "host", (share_of(c) / s).alias("mass")) for w, c, s in ways]
    counts = materialise(host_edges(named), "edges")
    both = counts.select(F.lit("trust").alias("way"), "src", "dst", "n").unionByName(
        counts.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("way", "src").agg(F.sum("n").alias("_out"))
    edges = both.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("_out")).alias("w"))
    scores = spread(edges, seeds[0].unionByName(seeds[1]))
    hosts = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("way") == w, F.col("score"))), F.lit(0.0)).alias(w) for w, _, _ in ways])
    judged = named.join(materialise(hosts, "scores"), "host", "left")
    bad = F.coalesce(F.col("distrust") > share * (F.col("trust") + F.col("distrust")), F.lit(False))
    judged = judged.withColumn("verdict", F.coalesce("_says", F.when(bad, "block").otherwise("allow")))
    return put_back(judged, names, "host", "path", "rule", "verdict", "trust", "distrust")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    href = HREF.replace("'", "''")
    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE rules(says, rule, name, start) AS (VALUES {rules}),
p AS (SELECT page_id, html, {az.format(f"regexp_extract(coalesce(url, ''), '{HOST}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
fit AS (SELECT p.page_id, p.host, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.says, length(r.rule)) AS says
  FROM p JOIN rules r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start) GROUP BY ALL),
seen AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0 END) AS b FROM fit GROUP BY host),
links AS (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM p WHERE host <> ''),
ends AS (SELECT host AS src, CASE WHEN regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) <> ''
    THEN {az.format("regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)")}
    WHEN NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN host END AS dst FROM links),
n AS (SELECT src, dst, count(*) AS n FROM ends WHERE dst IS NOT NULL GROUP BY ALL),
both_ways AS (SELECT 'trust' AS way, src, dst, n FROM n UNION ALL SELECT 'distrust', dst, src, n FROM n),
e AS (SELECT way, src, dst, n / sum(n) OVER (PARTITION BY way, src) AS w FROM both_ways),
stay AS (SELECT way, src, 1 / (1 - w * {DAMPING}) AS rounds FROM e WHERE src = dst),
step AS (SELECT e.way, e.src, e.dst, e.w * {DAMPING} * coalesce(rounds, 1) AS w FROM e LEFT JOIN stay ON stay.way = e.way AND stay.src = e.src WHERE e.src <> e.dst),
most AS (SELECT greatest(100, count(DISTINCT src)) AS steps FROM both_ways),
walk AS (
  SELECT 0 AS i, 'trust' AS way, host, {1 - DAMPING} * a / (SELECT sum(a) FROM seen) AS x FROM seen WHERE a > 0
  UNION ALL SELECT 0, 'distrust', host, {1 - DAMPING} * b / (SELECT sum(b) FROM seen) FROM seen WHERE b > 0
  UNION ALL SELECT i + 1, s.way, s.dst, sum(x * w) FROM walk JOIN step s ON s.way = walk.way AND s.src = walk.host WHERE i < (SELECT steps FROM most) GROUP BY i, s.way, s.dst),
h AS (SELECT walk.host, coalesce(sum(x * coalesce(rounds, 1)) FILTER (walk.way = 'trust'), 0) AS t, coalesce(sum(x * coalesce(rounds, 1)) FILTER (walk.way = 'distrust'), 0) AS d
  FROM walk LEFT JOIN stay ON stay.way = walk.way AND stay.src = walk.host GROUP BY walk.host)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, CASE WHEN h.d > {BLOCK_SHARE} * (h.t + h.d) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id LEFT JOIN h ON h.host = p.host"""


@query("op8_url_filters", _sql())
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
