"""The registered queries of the audit, over the driver's tables, and the SQL that says the same.

Where a query needs a crawl's facts, they are the synthetic ones of `overlay`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import crawl, graph, pacing, robots, rollups
from ..operators import rules as R
from ..operators import views as V
from ..sources.tables import kept
from . import captures, parsing, probing
from . import overlay as O
from .audit import audit


def _page_id(url: str = "url"):
    return F.regexp_extract(url, r"/p/(\d+)$", 1).cast("bigint")


def _findings(spark: SparkSession, sf_dir: str, *ids: str) -> DataFrame:
    pages, sites = O.pooled(spark, sf_dir)
    found = R.packed(V.with_views(pages, sites), "pages")
    return found.where(F.col("check_id").isin(*ids)) if ids else found


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X*: facts of each page as it is."""
    d = F.col("doc")
    return O.extracted(spark, sf_dir).select(
        "page_id", d["title"].alias("title"), d["title_count"].cast("bigint").alias("title_count"), d["lang"].alias("lang"), d["has_viewport"].alias("has_viewport"),
        F.size(d["links"]).cast("bigint").alias("n_links"), F.size(d["headings"]).cast("bigint").alias("n_headings"), F.size(d["scripts"]).cast("bigint").alias("n_scripts"), d["word_count"].cast("bigint").alias("word_count"),
        F.array_join(F.transform(d["links"], lambda x: x["text"]), "|").alias("link_texts"), F.array_join(F.transform(d["headings"], lambda x: F.concat(x["level"].cast("string"), F.lit(" "), x["text"])), "|").alias("headings"),
    )


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on titles, headings and text of the pages as they are."""
    pages, sites = O.pooled(spark, sf_dir, augmented=False)
    pages = pages.withColumn("status", F.lit(200)).withColumn("failure", F.lit(None).cast("string"))
    found = R.packed(V.with_views(pages, sites), "pages", ("seo",)).where("check_id in ('SEO-TITLE-002', 'SEO-THIN-100', 'SEO-H1-020', 'SEO-VIEW-051', 'SEO-OG-060', 'SEO-LANG-050')")
    return found.groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min(_page_id()).alias("first_page"))


def markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on images, forms, links, scripts and metadata, each page and rule that fires."""
    found = _findings(spark, sf_dir, *[k for k in _MARKUP])
    return found.select(_page_id().alias("page_id"), "check_id", F.coalesce(F.size("evidence"), F.lit(0)).cast("bigint").alias("n_evidence"))


def transport_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on status, redirects, time, size and headers."""
    found = _findings(spark, sf_dir, *[k for k in _TRANSPORT])
    return found.select(_page_id().alias("page_id"), "check_id", "severity")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEO-TITLE-003 with each origin a site: pages that say noindex, or name another of their set as canonical, don't count."""
    return _duplicates(O.extracted(spark, sf_dir).withColumn("indexable", ~V.noindex()), U.origin(F.col("final_url")))


def duplicate_titles_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEO-TITLE-003 with all pages as one site, in which each page counts."""
    return _duplicates(O.extracted(spark, sf_dir).withColumn("indexable", F.lit(True)), F.lit("all"), variants=False)


def _duplicates(pages: DataFrame, site, variants: bool = True) -> DataFrame:
    pages = pages.select(site.alias("site_id"), F.col("page_id").cast("double").alias("ord"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), F.regexp_replace("final_url", "#.*", "").alias("final_url"), "indexable", "doc")
    return graph.duplicates(kept(pages, "titles"), "doc.title", variants).select("site_id", F.substring("url", 2, 20).cast("bigint").alias("page_id"), "value", F.array_join("others", ",").alias("others"), "n_others")


def inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1 over links that are in the pages, each origin a site: pages and the number of others that link to them."""
    pages = O.extracted(spark, sf_dir).select(U.origin(F.col("final_url")).alias("site_id"), F.col("page_id").cast("double").alias("ord"), F.col("final_url").alias("url"), "doc")
    targets = graph.edges(kept(pages, "links")).groupBy("site_id", "target").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_links"))
    return targets.select("site_id", F.col("target").alias("target_url"), "n_sources", "n_links")


def canonical_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sites = O.pooled(spark, sf_dir)
    found = audit(pages, sites, groups=("seo",)).findings
    return found.where("check_id in ('SEO-CANON-030', 'SEO-CANON-033', 'SEO-DESC-012')").groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))


def page_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PERF-WEIGHT-*: each page uses three resources, of made-up sizes, of which every fifth is not measured."""
    pages, sites = O.pooled(spark, sf_dir)
    used = pages.select("site_id", "page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("asset", (F.col("page_id") + F.col("k") * 13) % 97)
    assets = used.select("site_id", "asset").distinct().select("site_id", F.col("asset").cast("string").alias("url"), ((F.col("asset") * 7919 * 61) % 6_000_000).cast("bigint").alias("bytes"), (F.col("asset") % 5 != 0).alias("measured"))
    weights = graph.page_weights(V.with_views(pages, sites), assets, used.select("site_id", F.col("asset").cast("string").alias("url"), F.col("url").alias("page")).distinct())
    return weights.select(_page_id().alias("page_id"), "total", "not_measured", F.when(F.col("total") > 5_000_000, "PERF-WEIGHT-041").when(F.col("total") > 2_000_000, "PERF-WEIGHT-040").alias("check_id"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each resource once, how it is used first, and by how many pages."""
    pages, sites = O.pooled(spark, sf_dir)
    return graph.assets(V.with_views(pages, sites)).select("url", "kind", "third_party", "n_pages", F.element_at("used_by", 1).alias("first_page"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-6: pages of the sitemap that no page links to."""
    pages, sites = O.pooled(spark, sf_dir)
    found = graph.relations(V.with_views(pages, sites), V.complete(sites, V.SITE_COLUMNS), V.empty(pages, V.ASSET_COLUMNS), V.empty(pages, V.SITEMAP_URL_COLUMNS))
    return reduce(DataFrame.unionByName, found).where("check_id = 'SEO-MAP-094'").select(_page_id().alias("page_id"), "check_id")


def _audited(spark: SparkSession, sf_dir: str):
    pages, sites = O.pooled(spark, sf_dir)
    return audit(pages, sites, groups=("health",))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass, fail or not-applicable, of the health rules."""
    return _audited(spark, sf_dir).outcomes.select("check_id", "status", F.col("n").cast("bigint").alias("n"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by group and severity, with a row of totals."""
    pages, sites = O.pooled(spark, sf_dir)
    found = R.packed(V.with_views(pages, sites), "pages").where(F.col("check_id").isin(*_TRANSPORT))
    return rollups.summary_rows(found, sites).select("group", *R.SEVERITIES)


def fix_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: what to fix first, among the transport rules."""
    found = _findings(spark, sf_dir, *_TRANSPORT)
    failed = found.select("site_id", "check_id").distinct().withColumn("severity", F.coalesce(*[F.when(F.col("check_id") == r.id, r.severity) for r in R.registry()])).withColumn("status", F.lit("fail"))
    return rollups.fix_first(found, failed).select(F.col("rank").cast("bigint").alias("rank"), "check_id", "severity", F.col("affected").cast("bigint").alias("affected"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, A5: findings of the transport rules by page and severity."""
    pages, sites = O.pooled(spark, sf_dir)
    found = R.packed(V.with_views(pages, sites), "pages").where(F.col("check_id").isin(*_TRANSPORT))
    return rollups.page_counts(pages, found).select(_page_id().alias("page_id"), *R.SEVERITIES)


def shown_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten findings of each transport rule, and how many more there are."""
    found = _findings(spark, sf_dir, *_TRANSPORT).withColumn("url", F.lpad(_page_id().cast("string"), 12, "0"))
    return rollups.shown(found).select("check_id", F.col("url").cast("bigint").alias("page_id"), F.col("rank").cast("bigint").alias("rank"), F.col("more").cast("bigint").alias("more"))


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P3, J-8: whether robots.txt lets each page be fetched, with one made-up file for all sites."""
    urls = O.raw(spark, sf_dir).select("page_id", F.lit("site").alias("site_id"), F.regexp_replace("url", r"^https?://[^/]+", "").alias("path"))
    files = spark.range(1).select(F.lit("site").alias("site_id"), F.lit(_ROBOTS).alias("text"))
    return robots.decisions(urls, robots.parsed(files), "sitewright").select("page_id", "allowed")


def excluded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that path globs exclude."""
    return O.raw(spark, sf_dir).select("page_id", U.excluded(F.col("url"), ["/en/*", "/**/1*", "/fr/**9"]).alias("excluded"))


def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, J-13: breadth-first depths over the links in the pages' html, until there is no new page. No page is where a link says; the link's text decides which is."""
    pages = kept(O.extracted(spark, sf_dir).select("page_id", F.explode("doc.links.href").alias("href")), "links")
    n = O.raw(spark, sf_dir).count()
    leads = F.conv(F.left(F.md5(F.col("href").cast("binary")), F.lit(8)), 16, 10).cast("bigint") % n
    links = pages.select(F.lit("s").alias("site_id"), F.col("page_id").alias("source"), leads.alias("target"))
    start = O.raw(spark, sf_dir).where("page_id = 0").select(F.lit("s").alias("site_id"), F.col("page_id").alias("node"))
    return crawl.depths(links, start).select(F.col("node").alias("page_id"), F.col("depth").cast("bigint").alias("depth"))


def request_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request of a host starts, a second after the one before it at the earliest. Requests are the events of a user."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = dict(log.dtypes)
    user, at = _event_columns(kind)
    log = log.select(F.col(user).alias("host"), (F.unix_micros(F.col(at).cast("timestamp")) / 1000).cast("bigint").alias("arrive_ms"), F.col("event_id").alias("request"))
    return pacing.starts(log, 1000).select("request", "start_ms")


def _event_columns(kind: dict[str, str]) -> tuple[str, str]:
    user = next(c for c in kind if c in ("user_id", "device_id", "session_id", "key"))
    at = next(c for c, t in kind.items() if t.startswith("timestamp"))
    return user, at


def tidy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, clipped and measured texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.tidy(text).alias("t"))
    return docs.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(T.clip_end(F.col("t"), 200).cast("binary")).alias("clipped_end"), F.md5(T.clip_middle(F.col("t"), 300).cast("binary")).alias("clipped_middle"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made safe for HTML, of whole documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(T.escape_html(F.coalesce("text", F.lit(""))).cast("binary")).alias("escaped"))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and largest page of each origin, and the host that would be its sibling."""
    url = F.col("url")
    return O.raw(spark, sf_dir).groupBy(U.origin(url).alias("origin")).agg(F.count(F.lit(1)).alias("n_pages"), F.max(F.octet_length("html")).cast("bigint").alias("largest"), F.first(F.concat(F.lit("www."), U.hostname(url))).alias("www"))


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*7$\nAllow: /de/\n\nUser-agent: sitewright\nUser-agent: other\nDisallow: /en/\nAllow: /en/*5\nDisallow: /fr/ # no\nDisallow: /*33$\n"
_MARKUP = (
    "A11Y-ALT-001", "A11Y-LABEL-010", "A11Y-LINK-020", "A11Y-LINK-021", "A11Y-BTN-030", "A11Y-HEAD-040", "A11Y-FRAME-050", "PERF-IMG-052", "PERF-IMG-053", "PERF-BLOCK-060", "PERF-BLOCK-061",
    "SEO-LD-070", "SEO-VIEW-051", "SEO-DESC-010", "SEO-DESC-011", "SEO-INDEX-040", "SEO-INDEX-041", "HEALTH-HTTPS-021",
)
_TRANSPORT = ("PERF-RESP-001", "PERF-HTML-010", "PERF-COMP-020", "HEALTH-LINK-001", "HEALTH-LINK-002", "HEALTH-REDIR-010", "HEALTH-FETCH-070", "SEO-MAP-092")

QUERIES = {
    f.__name__: f
    for f in (page_facts, text_rules, markup_rules, transport_rules, duplicate_titles, duplicate_titles_pooled, inlinks, canonical_rules, resources, orphans, page_weights, outcomes, summary, fix_first, page_counts, shown_findings, robots_decisions, excluded_pages, crawl_depths, request_pacing, tidy_texts, escaped_texts, origins)
} | captures.QUERIES | parsing.QUERIES | probing.QUERIES

# SQL --------------------------------------------------------------------------------------------------------------------


def _decoded(x: str) -> str:
    for raw, safe in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({_decoded(x)}, '\\s+', ' ', 'g'))"


def _facts(html: str) -> str:
    """Facts of pages by regular expressions, as the relation `facts`."""
    bare = f"regexp_replace(regexp_replace({html}, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g')"
    body = f"regexp_extract({bare}, '(?s)<body[^>]*>(.*)$', 1)"
    return f"""facts AS (
  SELECT page_id, url, {html} AS h,
         {_collapsed(f"regexp_extract({html}, '(?s)<title>(.*?)</title>', 1)")} AS title,
         CAST(len(regexp_extract_all({html}, '<title>')) AS BIGINT) AS title_count,
         nullif(regexp_extract({html}, '<html[^>]*lang="([^"]*)"', 1), '') AS lang,
         regexp_matches({html}, '<meta name="viewport"') AS has_viewport,
         CAST(len(regexp_extract_all({html}, '<a href=')) AS BIGINT) AS n_links,
         CAST(len(regexp_extract_all({html}, '<h[1-6][^>]*>')) AS BIGINT) AS n_headings,
         CAST(len(regexp_extract_all({html}, '<script')) AS BIGINT) AS n_scripts,
         CAST(len(regexp_extract_all({_decoded(f"regexp_replace({body}, '<[^>]*>', ' ', 'g')")}, '\\S+')) AS BIGINT) AS word_count,
         array_to_string(list_transform(regexp_extract_all({html}, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda x: {_collapsed("x")}), '|') AS link_texts,
         array_to_string(list_transform(regexp_extract_all({html}, '(?s)<h([1-6]>.*?)</h[1-6]>', 1), lambda x: {_collapsed("replace(x, '>', ' ')")}), '|') AS headings
  FROM pages)"""


_OVERLAID = f"""o AS (
  SELECT page_id, html, {O.AUGMENTED} AS h, {O.STATUS} AS status, {O.FAILURE} AS failure, {O.HOPS} AS hops, (page_id * 37) % 1600 AS response_ms,
         strlen(html) AS bytes, page_id % 3 = 0 AS packed, page_id % 2 = 0 AS in_sitemap, page_id % 4 = 1 AS linked
  FROM pages)"""
_FIRED = f"""{_OVERLAID},
v AS (SELECT *, coalesce(status = 200, false) AS is_page FROM o),
fired AS (
  SELECT page_id, 'PERF-RESP-001' AS check_id, 'warning' AS severity, 'performance' AS grp FROM v WHERE is_page AND response_ms > 800
  UNION ALL SELECT page_id, 'PERF-HTML-010', 'warning', 'performance' FROM v WHERE is_page AND bytes > 500000
  UNION ALL SELECT page_id, 'PERF-COMP-020', 'error', 'performance' FROM v WHERE is_page AND bytes > 1024 AND NOT packed
  UNION ALL SELECT page_id, 'HEALTH-LINK-001', CASE WHEN status IN (429, 503) THEN 'info' ELSE 'error' END, 'health' FROM v WHERE linked AND (failure IS NOT NULL OR status >= 400)
  UNION ALL SELECT page_id, 'HEALTH-LINK-002', 'warning', 'health' FROM v WHERE linked AND hops >= 1 AND failure IS NULL AND status = 200
  UNION ALL SELECT page_id, 'HEALTH-REDIR-010', 'warning', 'health' FROM v WHERE hops > 1
  UNION ALL SELECT page_id, 'HEALTH-FETCH-070', 'warning', 'health' FROM v WHERE failure = 'timeout'
  UNION ALL SELECT page_id, 'SEO-MAP-092', 'error', 'seo' FROM v WHERE in_sitemap AND (status IS NULL OR status NOT IN (429, 503)) AND (status IS NULL OR status != 200 OR hops > 0))"""
_OWN = {"HEALTH-LINK-001": "error"}


def _markup(check: str, when: str, n: str, base: str = "is_page") -> str:
    return f"SELECT page_id, '{check}' AS check_id, CAST(least(5, {n}) AS BIGINT) AS n_evidence FROM m WHERE {base} AND {when}"


_INDEX = "is_page AND NOT noindex"
_MARKUP_SQL = f"""WITH {_OVERLAID},
m AS (
  SELECT page_id, h, coalesce(status = 200, false) AS is_page, in_sitemap, regexp_extract_all(h, '<img[^>]*>') AS imgs, regexp_matches(h, '<meta name="robots" content="[^"]*noindex') AS noindex,
         regexp_extract(h, '<meta name="description" content="([^"]*)"', 1) AS d,
         list_transform(regexp_extract_all(h, '<h([1-6])[^>]*>', 1), lambda x: CAST(x AS INTEGER)) AS hs, regexp_extract(h, '(?s)^.*?</head>', 0) AS head
  FROM o),
g AS (SELECT 1)
""" + " UNION ALL ".join(
    [
        _markup("A11Y-ALT-001", "len(list_filter(imgs, lambda x: NOT regexp_matches(x, ' alt='))) > 0", "len(list_filter(imgs, lambda x: NOT regexp_matches(x, ' alt=')))"),
        _markup("A11Y-LABEL-010", "regexp_matches(h, '<input type=\"text\"')", "len(regexp_extract_all(h, '<input type=\"text\"'))"),
        _markup("A11Y-LINK-020", "regexp_matches(h, '<a [^>]*></a>')", "len(regexp_extract_all(h, '<a [^>]*></a>'))"),
        _markup("A11Y-LINK-021", "regexp_matches(h, '<a [^>]*>Read more.</a>')", "len(regexp_extract_all(h, '<a [^>]*>Read more.</a>'))"),
        _markup("A11Y-BTN-030", "regexp_matches(h, '<button[^>]*></button>')", "len(regexp_extract_all(h, '<button[^>]*></button>'))"),
        _markup("A11Y-HEAD-040", "len(list_filter(range(2, len(hs) + 1), lambda i: hs[i] > hs[i - 1] + 1)) > 0", "len(list_filter(range(2, len(hs) + 1), lambda i: hs[i] > hs[i - 1] + 1))"),
        _markup("A11Y-FRAME-050", "regexp_matches(h, '<iframe')", "len(regexp_extract_all(h, '<iframe'))"),
        _markup("PERF-IMG-052", "len(list_filter(imgs, lambda x: NOT (regexp_matches(x, ' width=') AND regexp_matches(x, ' height=')))) > 0", "len(list_filter(imgs, lambda x: NOT (regexp_matches(x, ' width=') AND regexp_matches(x, ' height='))))"),
        _markup("PERF-IMG-053", "len(list_filter(imgs[4:], lambda x: NOT regexp_matches(x, 'loading=\"lazy\"'))) > 0", "len(list_filter(imgs[4:], lambda x: NOT regexp_matches(x, 'loading=\"lazy\"')))"),
        _markup("PERF-BLOCK-060", "regexp_matches(head, '<script src=\"[^\"]*\">')", "len(regexp_extract_all(head, '<script src=\"[^\"]*\">'))"),
        _markup("PERF-BLOCK-061", "len(regexp_extract_all(head, 'rel=\"stylesheet\"')) > 4", "len(regexp_extract_all(head, 'rel=\"stylesheet\"'))"),
        _markup("SEO-LD-070", "len(list_filter(regexp_extract_all(h, '(?s)ld\\+json\">(.*?)</script>', 1), lambda x: NOT json_valid(x))) > 0", "0", _INDEX),
        _markup("SEO-VIEW-051", "NOT regexp_matches(h, 'name=\"viewport\"')", "0", _INDEX),
        _markup("SEO-DESC-010", "trim(d) = ''", "0", _INDEX),
        _markup("SEO-DESC-011", "trim(d) != '' AND NOT length(trim(d)) BETWEEN 50 AND 160", "0", _INDEX),
        _markup("SEO-INDEX-040", "noindex", "0"),
        _markup("SEO-INDEX-041", "noindex AND in_sitemap", "0"),
        _markup("HEALTH-HTTPS-021", "regexp_matches(h, '<img src=\"http://')", "len(regexp_extract_all(h, '<img src=\"http://'))"),
    ]
)


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_COUNTED = f"""i AS (
  SELECT {_ORIGIN} AS site_id, page_id, regexp_replace(url, '#.*', '') AS url, lower(title) AS value,
         list_transform(regexp_extract_all(regexp_extract(h, '(?s)^.*?</head>', 0), '<link rel="canonical" href="([^"]*)"', 1), lambda c: regexp_replace(CASE WHEN starts_with(c, '/') THEN {_ORIGIN} || c ELSE c END, '#.*', '')) AS canonicals
  FROM facts WHERE title != '' AND NOT regexp_matches(h, '<meta name="robots" content="[^"]*noindex')),
x AS (SELECT site_id, page_id, url, value, unnest(canonicals) AS target FROM i),
v AS (SELECT DISTINCT x.site_id, x.page_id, x.value FROM x JOIN i ON i.site_id = x.site_id AND i.value = x.value AND i.url = x.target WHERE x.target != x.url),
t AS (SELECT site_id, page_id, value FROM i ANTI JOIN v USING (site_id, page_id, value))"""


def _duplicates_sql(members: str) -> str:
    return f"""WITH {_facts("html")},
{members},
s AS (SELECT *, count(*) OVER (PARTITION BY site_id, value) AS n FROM t)
SELECT a.site_id, a.page_id, a.value,
       array_to_string((SELECT list('p' || b.page_id ORDER BY b.page_id) FROM s b WHERE b.site_id = a.site_id AND b.value = a.value AND b.page_id != a.page_id)[1:5], ',') AS others, a.n - 1 AS n_others
FROM s a WHERE a.n >= 2"""


SQL = {
    "page_facts": f"WITH {_facts('html')} SELECT page_id, nullif(title, '') AS title, title_count, lang, has_viewport, n_links, n_headings, n_scripts, word_count, link_texts, headings FROM facts",
    "text_rules": f"""WITH {_facts('html')},
fired AS (
  SELECT 'SEO-TITLE-002' AS check_id, 'info' AS severity, page_id FROM facts WHERE title != '' AND NOT length(title) BETWEEN 10 AND 60
  UNION ALL SELECT 'SEO-THIN-100', 'info', page_id FROM facts WHERE word_count < 150
  UNION ALL SELECT 'SEO-H1-020', 'warning', page_id FROM facts WHERE NOT regexp_matches(h, '<h1[ >]')
  UNION ALL SELECT 'SEO-VIEW-051', 'error', page_id FROM facts WHERE NOT has_viewport
  UNION ALL SELECT 'SEO-OG-060', 'info', page_id FROM facts WHERE NOT regexp_matches(h, 'property="og:')
  UNION ALL SELECT 'SEO-LANG-050', 'warning', page_id FROM facts WHERE lang IS NULL)
SELECT check_id, severity, count(*) AS n, min(page_id) AS first_page FROM fired GROUP BY ALL""",
    "markup_rules": _MARKUP_SQL,
    "transport_rules": f"WITH {_FIRED} SELECT page_id, check_id, severity FROM fired",
    "duplicate_titles": _duplicates_sql(_COUNTED),
    "duplicate_titles_pooled": _duplicates_sql("t AS (SELECT 'all' AS site_id, page_id, lower(title) AS value FROM facts WHERE title != '')"),
    "canonical_rules": f"""WITH {_OVERLAID},
m AS (SELECT page_id, regexp_extract_all(h, '<link rel="canonical" href="([^"]*)"', 1) AS cs, lower(trim(regexp_extract(h, '<meta name="description" content="([^"]*)"', 1))) AS d
      FROM o WHERE status = 200 AND NOT regexp_matches(h, '<meta name="robots" content="[^"]*noindex')),
dup AS (SELECT d FROM m WHERE d != '' GROUP BY d HAVING count(*) >= 2),
fired AS (
  SELECT 'SEO-CANON-030' AS check_id FROM m WHERE len(cs) = 0
  UNION ALL SELECT 'SEO-CANON-033' FROM m WHERE len(list_filter(cs, lambda c: NOT starts_with(c, 'https://site.example/'))) > 0
  UNION ALL SELECT 'SEO-DESC-012' FROM m WHERE d IN (SELECT d FROM dup))
SELECT check_id, count(*) AS n FROM fired GROUP BY check_id""",
    "resources": f"""WITH {_OVERLAID},
found AS (
  SELECT page_id, 1 AS k, 'image' AS kind, unnest(regexp_extract_all(h, '<img[^>]* ?src="([^"]*)"', 1)) AS u FROM o
  UNION ALL SELECT page_id, 2, 'script', unnest(regexp_extract_all(h, '<script src="([^"]*)"', 1)) FROM o
  UNION ALL SELECT page_id, 3, 'stylesheet', unnest(regexp_extract_all(h, '<link rel="stylesheet" href="([^"]*)"', 1)) FROM o),
full_ AS (SELECT page_id, k, kind, CASE WHEN u LIKE 'http%' THEN u ELSE 'https://site.example' || u END AS url FROM found)
SELECT url, first(kind ORDER BY page_id, k) AS kind, NOT starts_with(url, 'https://site.example/') AS third_party, count(DISTINCT page_id) AS n_pages,
       'https://site.example/p/' || min(page_id) AS first_page FROM full_ GROUP BY url""",
    "orphans": f"WITH {_OVERLAID} SELECT page_id, 'SEO-MAP-094' AS check_id FROM o WHERE status = 200 AND in_sitemap AND NOT linked AND page_id != 1",
    "page_weights": f"""WITH {_OVERLAID},
used AS (SELECT page_id, (page_id + k * 13) % 97 AS asset FROM o, (SELECT unnest([0, 1, 2]) AS k)),
pairs AS (SELECT DISTINCT page_id, asset FROM used),
sums AS (SELECT page_id, sum(CASE WHEN asset % 5 != 0 THEN (asset * 7919 * 61) % 6000000 END) AS a, count(*) FILTER (asset % 5 = 0) AS not_measured FROM pairs GROUP BY page_id),
w AS (SELECT page_id, CAST(bytes + coalesce(a, 0) AS BIGINT) AS total, not_measured FROM o JOIN sums USING (page_id) WHERE status = 200)
SELECT page_id, total, not_measured, CASE WHEN total > 5000000 THEN 'PERF-WEIGHT-041' WHEN total > 2000000 THEN 'PERF-WEIGHT-040' END AS check_id FROM w""",
    "summary": f"""WITH {_FIRED},
groups AS (SELECT unnest(['seo', 'health', 'performance', 'accessibility']) AS grp),
rows AS (SELECT g.grp, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM groups g LEFT JOIN fired f ON f.grp = g.grp GROUP BY g.grp)
SELECT grp AS "group", error, warning, info FROM rows UNION ALL SELECT 'Total', CAST(sum(error) AS BIGINT), CAST(sum(warning) AS BIGINT), CAST(sum(info) AS BIGINT) FROM rows""",
    "fix_first": f"""WITH {_FIRED},
own AS (SELECT DISTINCT check_id, CASE WHEN check_id IN ('HEALTH-LINK-001', 'PERF-COMP-020', 'SEO-MAP-092') THEN 'error' ELSE 'warning' END AS severity FROM fired),
n AS (SELECT check_id, count(DISTINCT page_id) AS affected FROM fired WHERE severity != 'info' GROUP BY check_id),
r AS (SELECT row_number() OVER (ORDER BY CASE own.severity WHEN 'error' THEN 0 ELSE 1 END, affected DESC, check_id) AS rank, check_id, own.severity, affected FROM own JOIN n USING (check_id))
SELECT * FROM r WHERE rank <= 5""",
    "page_counts": f"""WITH {_FIRED}
SELECT p.page_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info
FROM pages p LEFT JOIN fired f USING (page_id) GROUP BY p.page_id""",
    "shown_findings": f"""WITH {_FIRED},
r AS (SELECT check_id, page_id, row_number() OVER (PARTITION BY check_id ORDER BY page_id) AS rank, greatest(0, count(*) OVER (PARTITION BY check_id) - 10) AS more FROM fired)
SELECT * FROM r WHERE rank <= 10""",
    "robots_decisions": """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages),
rules(pattern, n, allow) AS (VALUES ('/en/%', 4, false), ('/en/%5%', 6, true), ('/fr/%', 4, false), ('/%33', 5, false)),
m AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, allow DESC) AS k FROM p JOIN rules ON path LIKE pattern)
SELECT p.page_id, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1""",
    "excluded_pages": """SELECT page_id, regexp_matches(p, '^/en/[^/]*$') OR regexp_matches(p, '^/.*/1[^/]*$') OR regexp_matches(p, '^/fr/.*9$') AS excluded
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)""",
    # no shortest way is of 60 links; each level holds a page once
    "crawl_depths": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
e AS (SELECT DISTINCT page_id AS a, CAST('0x' || left(md5({_decoded("href")}), 8) AS BIGINT) % n AS b FROM l, n),
r AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 60)
SELECT node AS page_id, min(depth) AS depth FROM r GROUP BY node""",
    "inlinks": """WITH l AS (
  SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site_id, url AS source, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)
SELECT site_id, site_id || url_encode_path AS target_url, count(DISTINCT source) AS n_sources, count(*) AS n_links
FROM (SELECT site_id, source, replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url_encode_path FROM l) GROUP BY ALL""",
    "outcomes": f"""WITH {_OVERLAID},
v AS (SELECT *, coalesce(status = 200, false) AS is_page FROM o),
start AS (SELECT packed FROM v WHERE page_id = 1 AND is_page),
n(check_id, applies, n) AS (
  SELECT 'HEALTH-LINK-001', true, count(*) FROM v WHERE linked AND (failure IS NOT NULL OR status >= 400)
  UNION ALL SELECT 'HEALTH-LINK-002', true, count(*) FROM v WHERE linked AND hops >= 1 AND failure IS NULL AND status = 200
  UNION ALL SELECT 'HEALTH-REDIR-010', true, count(*) FROM v WHERE hops > 1
  UNION ALL SELECT 'HEALTH-REDIR-011', true, 0
  UNION ALL SELECT 'HEALTH-HTTPS-020', true, 1
  UNION ALL SELECT 'HEALTH-HTTPS-021', true, count(*) FROM v WHERE is_page AND regexp_matches(h, '<img src="http://')
  UNION ALL SELECT 'HEALTH-HTTPS-022', true, count(*) FROM v WHERE is_page AND regexp_matches(h, '<a href="http://site.example')
  UNION ALL SELECT 'HEALTH-HOST-023', false, 0
  UNION ALL SELECT 'HEALTH-404-030', true, 1
  UNION ALL SELECT 'HEALTH-FAV-040', true, 1
  UNION ALL SELECT 'HEALTH-HDR-050', true, count(*) FROM start
  UNION ALL SELECT 'HEALTH-HDR-051', true, count(*) FROM start
  UNION ALL SELECT 'HEALTH-HDR-052', true, count(*) FROM start
  UNION ALL SELECT 'HEALTH-HDR-053', true, count(*) FROM start
  UNION ALL SELECT 'HEALTH-HDR-054', true, count(*) FROM start
  UNION ALL SELECT 'HEALTH-EXT-060', false, 0
  UNION ALL SELECT 'HEALTH-FETCH-070', true, count(*) FROM v WHERE failure = 'timeout')
SELECT check_id, CASE WHEN NOT applies THEN 'not-applicable' WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n FROM n""",
    "request_pacing": """WITH r AS (SELECT event_id AS request, user_id AS host, epoch_us(ts) // 1000 AS arrive_ms FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrive_ms, request) AS k FROM r)
SELECT request, CAST(k * 1000 + max(arrive_ms - k * 1000) OVER (PARTITION BY host ORDER BY k) AS BIGINT) AS start_ms FROM p""",
    "tidy_texts": """WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\x{A0}]+', ' ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g'), ' +', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END) AS clipped_end,
       md5(CASE WHEN length(t) > 300 THEN left(t, 149) || '...' || right(t, 148) ELSE t END) AS clipped_middle FROM t""",
    "escaped_texts": """SELECT doc_id, md5(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM documents""",
    "origins": """SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, count(*) AS n_pages, max(strlen(html)) AS largest, first('www.' || regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS www FROM pages GROUP BY 1""",
} | captures.SQL | parsing.SQL | probing.SQL
