"""Registered queries over many small sites: ten pages of the `pages` table each, with made-up facts of a crawl, and their SQL.

Facts are arithmetic on page_id and on the site's number, said in SQL that Spark and DuckDB share, so all of them grow with the
table. `site_audit` runs all rules; the other queries run sources and operators that stand before and after the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, robots, rollups
from ..operators import rules as R
from ..sources import html as H
from ..sources import lab, sitemaps, web
from ..sources.tables import kept
from . import overlay as O
from . import runs
from .audit import Options, audit

S = "CAST(floor(page_id / 10) AS BIGINT)"
ORIGIN = f"'https://s' || {S} || '.example'"
URL = f"{ORIGIN} || '/p/' || page_id"
FIRST = f"({S} * 10)"
MANY = "".join(f'<img src="/r/{k}.png" alt="r" width="1" height="1" loading="lazy">' for k in range(85))
HEAD = (
    "CASE WHEN page_id % 6 = 1 THEN '<title>Second</title>' ELSE '' END"
    f" || CASE WHEN page_id % 9 = 4 THEN '<link rel=\"canonical\" href=\"' || {URL} || '\"><link rel=\"canonical\" href=\"' || {ORIGIN} || '/p/' || (page_id + 1) || '\">' WHEN page_id % 9 = 5 THEN '<link rel=\"canonical\" href=\"' || {ORIGIN} || '/p/' || {FIRST} || '\">' ELSE '' END"
    " || CASE WHEN page_id % 20 = 0 THEN '<meta name=\"robots\" content=\"noindex\">' ELSE '' END"
)
BODY = (
    "CASE WHEN page_id % 8 = 2 THEN '<h1>again</h1>' ELSE '' END"
    f" || CASE WHEN page_id % 31 = 5 THEN '{MANY}' ELSE '' END"
    f" || '<a href=\"/p/' || ({FIRST} + (page_id * 3) % 10) || '\">other</a><a href=\"/p/' || ({FIRST} + page_id % 3) || '#top\">one</a><a href=\"https://x.example/' || (page_id % 50) || '\">out</a>'"
)
# a title inside a comment is none
TITLE = "CASE WHEN page_id % 7 = 3 THEN replace(replace(html, '<title>', '<!--'), '</title>', '-->') ELSE html END"
HTML = f"replace(replace({TITLE}, '</head>', {HEAD} || '</head>'), '</article>', {BODY} || '</article>')"
FAILURE = "CASE WHEN page_id % 29 = 7 THEN 'redirect-loop' WHEN page_id % 29 = 8 THEN 'too-many-redirects' END"
STATUS = f"CASE WHEN page_id % 29 IN (7, 8) THEN NULL WHEN page_id % 10 = 0 AND {S} % 5 = 3 THEN 404 WHEN page_id % 10 = 0 AND {S} % 5 = 4 THEN 503 ELSE 200 END"
REDIRECTED = f"(page_id % 10 = 0 AND {S} % 5 = 2)"
KIND = "CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'script' ELSE 'stylesheet' END"
BYTES = "CASE WHEN page_id % 11 != 0 THEN (page_id * 102947) % 1500000 END"
TYPE = "CASE WHEN page_id % 3 != 0 THEN 'text/javascript' WHEN page_id % 2 = 0 THEN 'image/png; x' ELSE 'image/webp' END"
ENCODING = "CASE WHEN page_id % 4 = 1 THEN 'br' END"
CACHE = "CASE page_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'no-store' WHEN 3 THEN 'max-age=10, public' WHEN 4 THEN 'max-age=86400' ELSE 'public' END"
OUT_STATUS = "CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 200 WHEN 3 THEN NULL WHEN 4 THEN 700 ELSE 301 END"
OUT_FAILURE = "CASE WHEN page_id % 6 = 3 THEN 'dns' END"
ROBOTS_STATUS = f"CASE {S} % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END"
FOUND = f"({S} % 8 NOT IN (0, 3) AND {S} % 16 NOT IN (13, 14))"
NAMED = f"({S} % 4 IN (0, 1))"
FILE_STATUS = f"CASE WHEN {S} % 16 IN (13, 14) THEN NULL WHEN {S} % 8 = 0 THEN 404 ELSE 200 END"
FILE_NOTE = f"CASE WHEN {S} % 16 IN (13, 14) THEN 'disallowed by robots.txt' WHEN {S} % 16 = 5 THEN 'not a sitemap' END"
HAS_FILE = f"{S} % 8 != 3"
ROBOTS = (
    "'User-agent: ' || CASE page_id % 3 WHEN 0 THEN '*' WHEN 1 THEN 'SiteWright' ELSE 'other' END || chr(10) || 'Crawl-delay: ' || (page_id % 40) || '.5' || chr(10)"
    " || 'Disallow: ' || CASE WHEN page_id % 4 = 0 THEN '/' ELSE '/x' END || chr(10) || 'Allow:' || CASE WHEN page_id % 8 = 0 THEN ' /y' ELSE '' END || chr(10) || 'Sitemap: https://e.com/' || page_id || '.xml # one'"
)
RULES = (
    "SEO-TITLE-001", "SEO-TITLE-004", "SEO-H1-021", "SEO-CANON-031", "SEO-CANON-032", "SEO-INDEX-042", "SEO-INDEX-043", "SEO-ROBOTS-080", "SEO-ROBOTS-081", "SEO-ROBOTS-082", "SEO-MAP-090", "SEO-MAP-091", "SEO-MAP-093",
    "HEALTH-REDIR-011", "HEALTH-HOST-023", "HEALTH-EXT-060", "PERF-COMP-021", "PERF-CACHE-030", "PERF-REQ-042", "PERF-IMG-050", "PERF-IMG-051", "PERF-IMG-054",
)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the sites, as page_ids of their first pages: the expressions above take them."""
    return O.raw(spark, sf_dir).select(F.expr(f"{FIRST} AS page_id")).distinct()


def _own(*columns: str) -> list:
    return [F.expr(f"CAST({S} AS STRING) AS site_id"), *map(F.expr, columns)]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.raw(spark, sf_dir).select(*_own("page_id", f"{URL} AS final_url", f"{HTML} AS html", "CAST(octet_length(html) AS BIGINT) AS bytes"))
    docs = H.documents(H.parsed(rows, "site_id", "page_id", "bytes"))
    hops = "array(named_struct('url', final_url || '/h', 'status', 301, 'location', final_url))"
    return docs.select(
        "site_id", "page_id", F.expr("CAST(page_id AS DOUBLE) AS ord"), F.col("final_url").alias("url"), "final_url", "bytes", "truncated", F.lit(True).alias("is_html"), F.expr(f"CAST({STATUS} AS INT) AS status"), F.expr(f"{FAILURE} AS failure"),
        F.expr(f"IF({STATUS} = 200, doc, NULL) AS doc"), F.expr(f"slice({hops}, 1, IF({REDIRECTED}, 1, 0)) AS hops"), F.expr("map('content-encoding', 'gzip') AS headers"), F.expr("page_id % 2 = 1 AS in_sitemap"), F.expr("CAST(100 AS BIGINT) AS response_ms"),
    )


def _audit(spark: SparkSession, sf_dir: str):
    every = _sites(spark, sf_dir)
    none = "CAST(NULL AS BOOLEAN)"
    sites = every.select(*_own(
        f"{ORIGIN} || '/p/' || {FIRST} AS start_url", f"{ORIGIN} AS origin", f"{FOUND} AS sitemap_found",
        f"named_struct('status', {ROBOTS_STATUS}, 'present', {ROBOTS_STATUS} = 200, 'disallow_all', {S} % 6 = 2, 'sitemaps', CASE WHEN {NAMED} THEN array({ORIGIN} || '/m.xml') ELSE CAST(array() AS ARRAY<STRING>) END, 'crawl_delay_ms', CAST(NULL AS BIGINT), 'ignored', {S} % 10 = 9) AS robots",
        f"named_struct('http_to_https', {none}, 'sibling_redirects', CASE {S} % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END, 'sibling_host', CASE WHEN {S} % 21 != 0 THEN 'www.s' || {S} || '.example' END, 'soft404', {none}, 'favicon', {none}) AS probes",
        f"{S} % 3 != 2 AS external_checked", f"array({ORIGIN} || '/p/' || ({FIRST} + 7)) AS blocked_by_robots",
    ))
    files = every.where(HAS_FILE).select(*_own("0 AS pos", f"{ORIGIN} || '/m.xml' AS url", f"CAST({FILE_STATUS} AS INT) AS status", f"{FILE_STATUS} <=> 200 AND ({FILE_NOTE}) IS NULL AS ok", f"{FILE_NOTE} AS note"))
    raw = O.raw(spark, sf_dir).select("page_id")
    place = "CAST(page_id % 10 AS INT) AS pos"
    urls = raw.where("page_id % 2 = 1").select(*_own(place, f"{URL} AS url"))
    external = raw.select(*_own(place, "'https://x.example/' || page_id AS url", f"CAST({OUT_STATUS} AS INT) AS status", f"{OUT_FAILURE} AS failure", f"array({URL}) AS used_by"))
    assets = raw.select(*_own(
        place, f"{ORIGIN} || '/a/' || page_id AS url", f"{KIND} AS kind", "page_id % 7 = 0 AS third_party", "200 AS status", f"CAST({BYTES} AS BIGINT) AS bytes", f"{TYPE} AS content_type", f"{ENCODING} AS content_encoding", f"{CACHE} AS cache_control",
        "page_id % 13 != 0 AS measured", f"array({URL}) AS used_by",
    ))
    return audit(_pages(spark, sf_dir), sites, assets, files, urls, external)


def _number(url: str = "url") -> F.Column:
    return F.nullif(F.regexp_extract(url, r"/(\d+)$", 1), F.lit("")).cast("bigint")


def site_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 69 rules over sites of ten pages; of the findings, those of the rules that no other query shows."""
    found = _audit(spark, sf_dir).findings.where(F.col("check_id").isin(*RULES))
    return found.select(F.col("site_id").cast("bigint").alias("site_id"), "check_id", "severity", _number().alias("page_id"), "detail")


def site_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether broken links to other sites or plain HTTP would fail a run, by site and by the limit that is asked for."""
    done = _audit(spark, sf_dir)
    found = done.findings.where("check_id IN ('HEALTH-EXT-060', 'SEO-MAP-091')")
    at = [rollups.exit_codes(found, done.facts, k).withColumnRenamed("exit_code", k) for k in ("error", "warning", "info", "never")]
    out = at[0]
    for more in at[1:]:
        out = out.join(more, "site_id")
    return out.select(F.col("site_id").cast("bigint").alias("site_id"), *[F.col(k).cast("bigint").alias(f"at_{k}") for k in ("error", "warning", "info", "never")])


def page_inlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1: how many other pages link to each page, and the first six of them."""
    linked = graph.with_inlinks(kept(_pages(spark, sf_dir).drop("failure"), "inlinks"))
    return linked.select("page_id", F.col("n_inlinks").cast("bigint").alias("n_inlinks"), F.array_join(F.transform("inlinks", lambda u: F.regexp_extract(u, r"(\d+)$", 1)), ",").alias("first"))


def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: links to other sites, each once, with the number of pages that have it and the first of them."""
    found = graph.external_links(kept(_pages(spark, sf_dir), "external"))
    return found.where("url LIKE 'https://x.example/%'").select(F.col("site_id").cast("bigint").alias("site_id"), "url", "n_pages", _number_of(F.get("used_by", F.lit(0))).alias("first_page"))


def _number_of(url: F.Column) -> F.Column:
    return F.regexp_extract(url, r"(\d+)$", 1).cast("bigint")


def robots_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a robots.txt file says beside its rules, and what fetching it means; a file per page."""
    status = "CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 204 END"
    files = O.raw(spark, sf_dir).select(F.expr("CAST(page_id AS STRING) AS site_id"), F.expr(f"{ROBOTS} AS text"), F.expr(f"CAST({status} AS INT) AS status"), F.expr("CASE WHEN page_id % 5 = 3 THEN 'dns' END AS failure"))
    rules = kept(robots.parsed(files), "robots")
    out = robots.states(files, "sitewright")
    for more in (robots.crawl_delays(rules, "sitewright"), robots.disallow_all(rules), robots.sitemaps(rules).drop("pos")):
        out = out.join(more, "site_id", "left")
    return out.select(F.col("site_id").cast("bigint").alias("page_id"), "present", "unreadable", "delay_ms", "clamped", "disallow_all", F.col("url").alias("sitemap"))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sitemaps of the sites: an index of two files for every third one; files hold at most ten URLs by their making."""
    entry = f"'<url><loc> ' || CASE WHEN page_id % 10 = 9 THEN 'https://elsewhere.example/p/' || page_id ELSE {URL} END || ' </loc></url>'"
    part = f"CASE WHEN {S} % 3 = 0 THEN 1 + page_id % 2 ELSE 0 END"
    lists = O.raw(spark, sf_dir).select(F.expr(f"{S} AS s"), F.expr(f"{part} AS part"), "page_id", F.expr(f"{entry} AS entry")).groupBy("s", "part")
    lists = lists.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "entry"))), lambda e: e["entry"]), "\n").alias("entries"))
    body = F.expr("""CASE WHEN s % 7 = 6 THEN '<html>' ELSE '<?xml version="1.0"?><urlset>' || entries || '</urlset>' END""")
    path = F.expr("'https://s' || s || '.example/' || CASE WHEN part = 0 THEN 'm' ELSE 'm' || part END || '.xml'")
    answers = lists.select(path.alias("url"), F.expr("CASE WHEN s % 11 = 10 THEN 404 ELSE 200 END AS status"), body.alias("html"))
    every = _sites(spark, sf_dir)
    index = every.where(f"{S} % 3 = 0").select(F.expr(f"{ORIGIN} || '/m.xml' AS url"), F.lit(200).alias("status"), F.expr(f"'<sitemapindex><sitemap><loc>' || {ORIGIN} || '/m1.xml</loc></sitemap><sitemap><loc>' || {ORIGIN} || '/m2.xml</loc></sitemap></sitemapindex>' AS html"))
    named = every.select(*_own("0 AS pos", f"{ORIGIN} || '/m.xml' AS url"))
    return sitemaps.loaded(named, kept(answers.unionByName(index), "sitemaps"), every.select(*_own(f"{ORIGIN} AS origin")))


def site_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start URL per page, over robots.txt files and redirects that page_id decides: where each leads, or why it can't be audited."""
    at = "'https://s' || page_id || '.example'"
    every = O.raw(spark, sf_dir).select("page_id", "html")
    said = lambda url, status, kind, to, body: F.struct(F.expr(url).alias("url"), F.expr(f"CAST({status} AS INT)").alias("status"), F.expr(f"map('content-type', {kind}, 'location', {to})").alias("headers"), F.expr(body).alias("html"))
    none = "CAST(NULL AS STRING)"
    to = f"CASE page_id % 7 WHEN 1 THEN 'https://www.s' || page_id || '.example/' WHEN 2 THEN 'https://hub.example/' WHEN 3 THEN '/no/x' WHEN 6 THEN '/a' ELSE {none} END"
    answers = F.array(
        said(f"{at} || '/robots.txt'", "CASE page_id % 5 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END", "'text/plain'", none, "CASE page_id % 5 WHEN 1 THEN 'User-agent: *\nDisallow: /no' ELSE '' END"),
        said(f"{at} || '/'", "CASE page_id % 7 WHEN 0 THEN 200 WHEN 4 THEN 404 WHEN 5 THEN 200 ELSE 301 END", "CASE page_id % 7 WHEN 5 THEN 'image/png' ELSE 'text/html' END", to, "html"),
        said(f"{at} || '/no/x'", "200", "'text/html'", none, "html"), said(f"{at} || '/a'", "302", "'text/html'", "'/'", "''"),
        said("'https://www.s' || page_id || '.example/robots.txt'", "404", "'text/plain'", none, "''"), said("'https://www.s' || page_id || '.example/'", "200", "'text/html'", none, "html"),
    )
    own = every.select("page_id", F.explode(answers).alias("a")).where("page_id % 5 != 4 or not endswith(a.url, '/robots.txt') or startswith(a.url, 'https://www.')").select("a.*")
    hub = every.groupBy().agg(F.min("html").alias("html")).select(F.explode(F.array(said("'https://hub.example/robots.txt'", "404", "'text/plain'", none, "''"), said("'https://hub.example/'", "200", "'text/html'", none, "html"))).alias("a")).select("a.*")
    answered = kept(own.unionByName(hub).withColumn("failure", F.lit(None).cast("string")), "web")
    files = kept(runs.robots_files(answered), "robots")
    rules = kept(robots.parsed(files.where("text is not null").select("site_id", "text")), "robots")
    starts = every.select(F.col("page_id").cast("string").alias("site_id"), F.expr(f"{at} || '/'").alias("start_url"))
    got = runs.opened(starts, answered, files, rules, Options())
    return got.select(F.col("site_id").cast("bigint").alias("page_id"), "origin", F.size("hops").cast("bigint").alias("n_hops"), "problem")


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files that were looked at."""
    return _listed(spark, sf_dir)[0].select(F.col("site_id").cast("bigint").alias("site_id"), F.col("pos").cast("bigint").alias("pos"), "url", F.col("status").cast("bigint").alias("status"), "ok", "note")


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What they list, of the site's own origin."""
    return _listed(spark, sf_dir)[1].select(F.col("site_id").cast("bigint").alias("site_id"), F.col("pos").cast("bigint").alias("pos"), _number().alias("page_id"))


def web_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at each page become one decoded answer. The first is throttled for every fourth page, all for every twelfth."""
    rows = O.raw(spark, sf_dir).select("page_id", "html", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    status = "CASE WHEN page_id % 12 = 0 THEN 503 WHEN page_id % 4 = 0 AND n = 1 THEN 429 WHEN page_id % 5 = 0 THEN NULL ELSE 200 END"
    error = "CASE WHEN page_id % 12 != 0 AND NOT (page_id % 4 = 0 AND n = 1) AND page_id % 5 = 0 THEN CASE page_id % 3 WHEN 0 THEN 'ENOTFOUND' WHEN 1 THEN 'CERT_HAS_EXPIRED' ELSE 'EWHAT' END END"
    kind = "CASE page_id % 6 WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/xhtml+xml' ELSE 'Text/HTML; charset=utf-8' END"
    captured = rows.select(
        F.expr("'https://e.com/a b/' || page_id AS url"), F.lit("GET").alias("method"), "n", F.expr(f"CAST({status} AS INT) AS status"), F.expr(f"{error} AS error"), F.expr(f"map('content-type', {kind}) AS headers"),
        F.expr(f"CASE WHEN ({status}) = 200 THEN encode(html, 'UTF-8') END AS body"),
    )
    got = web.answers(captured, most=20_000)
    return got.select(_number().alias("page_id"), F.col("status").cast("bigint").alias("status"), "failure", "bytes", F.coalesce("truncated", F.lit(False)).alias("truncated"), F.when(F.col("bytes") <= 20_000, F.length("html")).cast("bigint").alias("n_chars"), F.md5(F.left("html", F.lit(1000)).cast("binary")).alias("begin"), web.looks_like_html(F.lit(None).cast("string"), F.col("html")).alias("looks_like_html"))


def lab_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a page-speed tool, one document per page."""
    text = (
        "CASE WHEN page_id % 13 = 0 THEN '{oops' ELSE '{\"lighthouseVersion\": \"12.' || (page_id % 3) || '\", \"runtimeError\": {\"code\": \"' || CASE page_id % 17 WHEN 0 THEN 'NO_FCP' WHEN 1 THEN 'no such' ELSE 'NO_ERROR' END || '\"}, \"categories\": {\"performance\": {\"score\": 0.' || lpad(CAST(page_id % 100 AS STRING), 2, '0')"
        " || '}, \"seo\": {\"score\": ' || CASE WHEN page_id % 2 = 0 THEN 'null' ELSE '1' END || '}}, \"audits\": {\"first-contentful-paint\": {\"numericValue\": ' || (page_id * 7) || '}, \"cumulative-layout-shift\": {\"numericValue\": 0.' || lpad(CAST(page_id % 100 AS STRING), 2, '0') || '}}}' END"
    )
    rows = O.raw(spark, sf_dir).select(F.expr("CAST(page_id AS STRING) AS site_id"), F.expr(f"{URL} AS url"), F.expr(f"{text} AS json"))
    scores = lab.parsed(rows)
    said = lab.shown(scores).select("site_id", F.col("fcp_ms").alias("fcp"), F.col("lcp_ms").alias("lcp"), F.col("cls").alias("cls"))
    return scores.join(said, "site_id").select(F.col("site_id").cast("bigint").alias("page_id"), F.col("performance").cast("bigint").alias("performance"), F.col("seo").cast("bigint").alias("seo"), "version", "error", "fcp", "lcp", said["cls"].alias("cls"))


_VALUES = {
    "robots": "CASE page_id % 6 WHEN 0 THEN 'NoIndex, nofollow' WHEN 1 THEN 'somebot: noindex, nofollow' WHEN 2 THEN 'none, unavailable_after: Sat, 01 Jan 2028 10:00:00 GMT, noarchive' WHEN 3 THEN NULL WHEN 4 THEN ' , all' ELSE 'max-image-preview: large, bot: none' END",
    "cache": "CASE page_id % 6 WHEN 0 THEN 'public, Max-Age=' || (page_id * 100) WHEN 1 THEN 'expires' WHEN 2 THEN 'private, no-store' WHEN 3 THEN NULL WHEN 4 THEN 'immutable' ELSE 'public' END",
    "encoding": "CASE page_id % 4 WHEN 0 THEN 'GZIP' WHEN 1 THEN 'identity, br' WHEN 2 THEN NULL ELSE 'gz' END",
    "retry": "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || (page_id % 90) || ' ' WHEN 2 THEN 'soon' WHEN 3 THEN 'Thu, 01 Jan 1970 00:01:30 GMT' ELSE 'Thu, 01 Jan 1970 00:00:10 GMT' END",
    "content": "CASE page_id % 3 WHEN 0 THEN ' Text/HTML ; charset=x' WHEN 1 THEN NULL ELSE 'application/json' END",
}


def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What header values mean."""
    v = {k: F.expr(x) for k, x in _VALUES.items()}
    ms = F.expr("page_id * 977")
    return O.raw(spark, sf_dir).select(
        "page_id", F.array_join(T.robots_header(v["robots"]), "|").alias("robots"), T.cache_problem(v["cache"]).alias("cache"), T.is_compressed(v["encoding"]).alias("compressed"), T.retry_after_ms(v["retry"], F.lit(60_000)).alias("wait_ms"),
        T.mime_type(v["content"]).alias("mime"), T.is_html_type(v["content"]).alias("is_html"), T.duration_text(F.when(F.col("page_id") % 7 != 0, ms)).alias("took"), T.link_text(F.expr("CASE WHEN page_id % 2 = 0 THEN ' Read MORE! ' ELSE 'Click >> ' || page_id || ' »' END")).alias("said"),
    )


QUERIES = {f.__name__: f for f in (site_audit, site_exit_codes, page_inlinks, external_links, robots_facts, site_openings, sitemap_files, sitemap_urls, web_answers, lab_scores, header_values)}

# SQL --------------------------------------------------------------------------------------------------------------------

_ALL = f"""p AS (
  SELECT page_id, {S} AS s, {URL} AS url, {ORIGIN} AS origin, {STATUS} AS status, {FAILURE} AS failure, {REDIRECTED} AS moved, page_id % 20 = 0 AS noindex, coalesce({STATUS} = 200, false) AS is_page,
         {KIND} AS kind, {BYTES} AS bytes, {TYPE} AS type, {ENCODING} AS encoding, {CACHE} AS cache, page_id % 7 = 0 AS third, page_id % 13 != 0 AS measured, {OUT_STATUS} AS out_status, {OUT_FAILURE} AS out_failure,
         regexp_replace({HTML}, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
f AS (SELECT *, len(regexp_extract_all(h, '<title>')) AS n_titles, trim(regexp_extract(h, '(?s)<title>(.*?)</title>', 1)) AS title, len(regexp_extract_all(h, '<h1[ >]')) AS n_h1 FROM p),
sites AS (
  SELECT s, {ROBOTS_STATUS} AS robots, {FOUND} AS found, {NAMED} AS named, {FILE_STATUS} AS file_status, {FILE_NOTE} AS note, {HAS_FILE} AS has_file, s % 21 != 0 AS host FROM (SELECT DISTINCT s, s * 10 AS page_id FROM p)),
c AS (
  SELECT page_id, s, url, unnest([page_id, page_id + 1]) AS target FROM p WHERE page_id % 9 = 4 AND is_page AND NOT noindex
  UNION ALL SELECT page_id, s, url, s * 10 FROM p WHERE page_id % 9 = 5 AND is_page AND NOT noindex),
used AS (
  SELECT page_id, unnest(list_concat(regexp_extract_all(h, '<img[^>]* ?src="([^"]*)"', 1), list_concat(regexp_extract_all(h, '<script src="([^"]*)"', 1), regexp_extract_all(h, '<link rel="stylesheet" href="([^"]*)"', 1)))) AS u FROM p WHERE is_page),
many AS (SELECT page_id, count(DISTINCT u) AS n FROM used GROUP BY page_id HAVING count(DISTINCT u) > 80),
a AS (SELECT * FROM p WHERE measured AND bytes IS NOT NULL),
fired AS (
  SELECT s, 'SEO-TITLE-001' AS check_id, 'error' AS severity, page_id, 'The title element is missing or empty.' AS detail FROM f WHERE is_page AND NOT noindex AND title = ''
  UNION ALL SELECT s, 'SEO-TITLE-004', 'warning', page_id, 'The page holds ' || n_titles || ' title elements.' FROM f WHERE is_page AND NOT noindex AND n_titles > 1
  UNION ALL SELECT s, 'SEO-H1-021', 'info', page_id, 'There are ' || n_h1 || ' h1 headings.' FROM f WHERE is_page AND NOT noindex AND n_h1 > 1
  UNION ALL SELECT s, 'SEO-CANON-031', 'error', page_id, 'The page names 2 different canonical URLs.' FROM f WHERE is_page AND NOT noindex AND page_id % 9 = 4
  UNION ALL SELECT c.s, 'SEO-CANON-032', 'error', c.page_id, CASE WHEN t.moved THEN 'The canonical URL redirects.' WHEN t.status IS NULL THEN 'The canonical URL could not be loaded.' ELSE 'The canonical URL answers with status ' || t.status || '.' END
    FROM c JOIN p t ON t.s = c.s AND t.page_id = c.target WHERE t.page_id != c.page_id AND t.status IS DISTINCT FROM 429 AND t.status IS DISTINCT FROM 503 AND (t.moved OR t.status IS DISTINCT FROM 200)
  UNION ALL SELECT s, 'SEO-INDEX-042', 'error', page_id, 'The sitemap lists the URL, and robots.txt disallows it.' FROM p WHERE page_id % 10 = 7 AND s % 10 != 9
  UNION ALL SELECT s, 'SEO-INDEX-043', 'error', page_id, 'The start page says noindex.' FROM p WHERE page_id % 10 = 0 AND noindex AND is_page
  UNION ALL SELECT s, 'SEO-ROBOTS-080', 'warning', NULL, 'robots.txt answers with status ' || robots || '.' FROM sites WHERE robots = 404
  UNION ALL SELECT s, 'SEO-ROBOTS-081', 'error', NULL, 'robots.txt disallows all URLs for all crawlers.' FROM sites WHERE s % 6 = 2
  UNION ALL SELECT s, 'SEO-ROBOTS-082', 'error', NULL, 'robots.txt answers with status ' || robots || '.' FROM sites WHERE robots = 503
  UNION ALL SELECT s, 'SEO-MAP-090', 'warning', NULL,
    CASE WHEN named THEN 'robots.txt names a sitemap that could not be read' || CASE WHEN has_file THEN ': ' || coalesce(note, 'status ' || file_status) ELSE '' END || '.'
         WHEN has_file AND note = 'disallowed by robots.txt' THEN 'robots.txt names no sitemap and disallows /sitemap.xml.' ELSE 'robots.txt names no sitemap, and there is none at /sitemap.xml.' END
    FROM sites WHERE NOT found AND NOT (has_file AND coalesce(file_status = 200, false))
  UNION ALL SELECT s, 'SEO-MAP-091', 'info', NULL, 'There is a sitemap, but no Sitemap line in robots.txt.' FROM sites WHERE found AND NOT named AND has_file
  UNION ALL SELECT s, 'SEO-MAP-093', 'error', NULL, 'The sitemap file can''t be read (not a sitemap).' FROM sites WHERE has_file AND note = 'not a sitemap'
  UNION ALL SELECT s, 'HEALTH-REDIR-011', 'error', page_id, CASE failure WHEN 'redirect-loop' THEN 'The redirects form a loop.' ELSE 'There are more than 10 redirects.' END FROM p WHERE failure IS NOT NULL
  UNION ALL SELECT s, 'HEALTH-HOST-023', 'warning', NULL, 's' || s || '.example and www.s' || s || '.example both answer, and neither redirects to the other.' FROM sites WHERE s % 7 = 0 AND host
  UNION ALL SELECT s, 'HEALTH-EXT-060', CASE WHEN out_status IN (403, 700) THEN 'info' ELSE 'warning' END, page_id,
    CASE WHEN out_status IN (403, 700) THEN 'It can''t be told (status ' || out_status || '): many sites refuse automated requests.' WHEN out_failure IS NOT NULL THEN 'The request failed (dns).' ELSE 'It answers with status 404.' END
    FROM p WHERE s % 3 != 2 AND (out_failure IS NOT NULL OR out_status IN (404, 403, 700))
  UNION ALL SELECT s, 'PERF-COMP-021', 'warning', page_id, 'A ' || kind || ' of ' || bytes || ' bytes is sent uncompressed.' FROM a WHERE kind != 'image' AND bytes > 1024 AND encoding IS NULL
  UNION ALL SELECT s, 'PERF-CACHE-030', 'warning', page_id,
    CASE WHEN cache IS NULL THEN 'There is neither a Cache-Control nor an Expires header.' WHEN cache = 'no-store' THEN 'Cache-Control forbids storing.' WHEN cache = 'public' THEN 'Cache-Control names no max-age and there is no Expires header.' ELSE 'It may be kept for 10 seconds, less than an hour (3600).' END
    FROM a WHERE NOT third AND cache IS DISTINCT FROM 'max-age=86400'
  UNION ALL SELECT s, 'PERF-REQ-042', 'info', page_id, 'The page refers to ' || n || ' different scripts, stylesheets and images.' FROM many JOIN p USING (page_id)
  UNION ALL SELECT s, 'PERF-IMG-050', 'warning', page_id, 'The image has ' || bytes || ' bytes.' FROM a WHERE kind = 'image' AND bytes > 300000 AND bytes <= 1000000
  UNION ALL SELECT s, 'PERF-IMG-051', 'error', page_id, 'The image has ' || bytes || ' bytes.' FROM a WHERE kind = 'image' AND bytes > 1000000
  UNION ALL SELECT s, 'PERF-IMG-054', 'info', page_id, 'A image/png of ' || bytes || ' bytes.' FROM a WHERE kind = 'image' AND type = 'image/png; x' AND bytes > 100000)"""

SQL = {
    "site_audit": f"WITH {_ALL} SELECT s AS site_id, check_id, severity, page_id, detail FROM fired",
    "site_exit_codes": f"""WITH {_ALL},
w AS (SELECT sites.s, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 END) AS worst FROM sites LEFT JOIN fired ON fired.s = sites.s AND check_id IN ('HEALTH-EXT-060', 'SEO-MAP-091') GROUP BY sites.s)
SELECT s AS site_id, CAST(coalesce(worst <= 0, false) AS BIGINT) AS at_error, CAST(coalesce(worst <= 1, false) AS BIGINT) AS at_warning, CAST(coalesce(worst <= 2, false) AS BIGINT) AS at_info, CAST(0 AS BIGINT) AS at_never FROM w""",
    "page_inlinks": f"""WITH p AS (SELECT page_id, {S} AS s, coalesce({STATUS} = 200, false) AS is_page FROM pages),
l AS (SELECT DISTINCT page_id AS source, unnest([s * 10 + (page_id * 3) % 10, s * 10 + page_id % 3]) AS target FROM p WHERE is_page),
n AS (SELECT target, count(*) AS n, array_to_string(list(source ORDER BY source)[1:6], ',') AS first FROM l WHERE source != target GROUP BY target)
SELECT page_id, coalesce(n, 0) AS n_inlinks, coalesce(first, '') AS first FROM pages LEFT JOIN n ON target = page_id""",
    "external_links": f"""SELECT {S} AS site_id, 'https://x.example/' || (page_id % 50) AS url, count(*) AS n_pages, min(page_id) AS first_page FROM pages WHERE {STATUS} = 200 GROUP BY 1, 2""",
    "robots_facts": """SELECT page_id, page_id % 5 IN (0, 4) AS present, page_id % 5 IN (2, 3) AS unreadable,
       CASE WHEN page_id % 3 != 2 THEN CAST(least(30000, (page_id % 40) * 1000 + 500) AS BIGINT) END AS delay_ms, CASE WHEN page_id % 3 != 2 THEN page_id % 40 >= 30 END AS clamped,
       CASE WHEN page_id % 3 = 0 THEN page_id % 4 = 0 AND page_id % 8 != 0 END AS disallow_all, 'https://e.com/' || page_id || '.xml' AS sitemap FROM pages""",
    "site_openings": """WITH p AS (SELECT page_id, page_id % 5 AS r, page_id % 7 AS a, 'https://s' || page_id || '.example' AS o FROM pages), q AS (SELECT *, r NOT IN (2, 4) AS heard FROM p)
SELECT page_id, CASE WHEN heard AND a = 1 THEN 'https://www.s' || page_id || '.example' WHEN heard AND a = 2 THEN 'https://hub.example' ELSE o END AS origin, CAST(heard AND a IN (1, 2, 3, 6) AS BIGINT) AS n_hops,
       CASE WHEN r = 2 THEN 'robots.txt of ' || o || ' can''t be read (status 503).' WHEN r = 4 THEN 'robots.txt of ' || o || ' can''t be read (other).' WHEN a = 3 AND r = 1 THEN 'robots.txt disallows ' || o || '/no/x.'
            WHEN a = 4 THEN 'The start URL answers with status 404.' WHEN a = 5 THEN 'The start URL is no HTML page (image/png).' WHEN a = 6 THEN 'The start URL can''t be reached (redirect-loop).' END AS problem FROM q""",
    "sitemap_files": f"""WITH s AS (SELECT DISTINCT {S} AS s, count(*) FILTER (page_id % 2 = 1) OVER (PARTITION BY {S}) AS odd FROM pages),
f AS (
  SELECT s, 0 AS pos, 'm' AS name, s % 3 = 0 AS top, true AS there FROM s
  UNION ALL SELECT s, unnest([1, 2]), unnest(['m1', 'm2']), false, unnest([true, odd > 0]) FROM s WHERE s % 3 = 0)
SELECT s AS site_id, CAST(pos AS BIGINT) AS pos, 'https://s' || s || '.example/' || name || '.xml' AS url, CASE WHEN NOT there THEN NULL WHEN top THEN 200 WHEN s % 11 = 10 THEN 404 ELSE CAST(200 AS BIGINT) END AS status,
       there AND (top OR (s % 11 != 10 AND s % 7 != 6)) AS ok, CASE WHEN NOT there THEN 'not fetched' WHEN top THEN NULL WHEN s % 11 = 10 THEN 'status 404' WHEN s % 7 = 6 THEN 'not a sitemap' END AS note FROM f""",
    "sitemap_urls": f"""WITH u AS (SELECT {S} AS s, page_id FROM pages WHERE page_id % 10 != 9 AND {S} % 11 != 10 AND {S} % 7 != 6)
SELECT s AS site_id, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN s % 3 = 0 THEN page_id % 2 ELSE 0 END, page_id) - 1 AS pos, page_id FROM u""",
    "web_answers": """WITH a AS (SELECT page_id, html, CASE WHEN page_id % 12 = 0 THEN 503 WHEN page_id % 5 = 0 THEN NULL ELSE CAST(200 AS BIGINT) END AS status FROM pages),
b AS (SELECT *, CASE WHEN status = 200 THEN strlen(html) END AS bytes, CASE WHEN status = 200 AND page_id % 6 != 1 THEN html END AS text FROM a)
SELECT page_id, status, CASE WHEN page_id % 12 != 0 AND page_id % 5 = 0 THEN CASE page_id % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'tls' ELSE 'other' END END AS failure, bytes, coalesce(bytes > 20000, false) AS truncated, CASE WHEN bytes <= 20000 THEN length(text) END AS n_chars, md5(left(text, 1000)) AS begin,
       regexp_matches(lower(ltrim(left(coalesce(text, ''), 64))), '^<(!doctype html|html)') AS looks_like_html FROM b""",
    "lab_scores": """SELECT page_id, CASE WHEN page_id % 13 != 0 THEN page_id % 100 END AS performance, CASE WHEN page_id % 13 != 0 AND page_id % 2 = 1 THEN CAST(100 AS BIGINT) END AS seo, CASE WHEN page_id % 13 != 0 THEN '12.' || (page_id % 3) END AS version,
       CASE WHEN page_id % 13 = 0 THEN 'the result isn''t JSON' WHEN page_id % 17 = 0 THEN 'NO_FCP' WHEN page_id % 17 = 1 THEN 'unknown error' END AS error,
       CASE WHEN page_id % 13 = 0 THEN '-' ELSE printf('%.1f s', floor(page_id * 7 / 100 + 0.5) / 10) END AS fcp, '-' AS lcp, CASE WHEN page_id % 13 = 0 THEN '-' ELSE printf('%.2f', (page_id % 100) / 100) END AS cls FROM pages""",
    "header_values": """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'noindex|nofollow' WHEN 2 THEN 'none|noarchive' WHEN 4 THEN 'all' ELSE '' END AS robots,
       CASE page_id % 6 WHEN 0 THEN CASE WHEN page_id * 100 < 3600 THEN 'It may be kept for ' || (page_id * 100) || ' seconds, less than an hour (3600).' END WHEN 2 THEN 'Cache-Control forbids storing.' WHEN 3 THEN 'There is neither a Cache-Control nor an Expires header.' WHEN 5 THEN 'Cache-Control names no max-age and there is no Expires header.' END AS cache,
       page_id % 4 IN (0, 1) AS compressed, CAST(CASE page_id % 5 WHEN 1 THEN least(60000, (page_id % 90) * 1000) WHEN 3 THEN 30000 WHEN 4 THEN 0 ELSE 5000 END AS BIGINT) AS wait_ms,
       CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN '' ELSE 'application/json' END AS mime, page_id % 3 = 0 AS is_html,
       CASE WHEN page_id % 7 = 0 THEN 'not available' WHEN floor(page_id * 977 / 100 + 0.5) < 600 THEN printf('%.1f seconds', floor(page_id * 977 / 100 + 0.5) / 10)
            ELSE (total // 60) || CASE WHEN total // 60 = 1 THEN ' minute' ELSE ' minutes' END || CASE total % 60 WHEN 0 THEN '' WHEN 1 THEN ' 1 second' ELSE ' ' || (total % 60) || ' seconds' END END AS took,
       CASE WHEN page_id % 2 = 0 THEN 'read more' ELSE 'click >> ' || page_id END AS said FROM (SELECT page_id, CAST(floor(page_id * 977 / 1000 + 0.5) AS BIGINT) AS total FROM pages)""",
}
