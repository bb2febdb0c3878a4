"""Registered queries of probes over captured answers, and their SQL. Answers are arithmetic on page_id, said in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import probes, robots
from ..sources.tables import kept
from . import overlay as O

HOPS, END = "page_id % 13", "page_id % 9"
BASE = "'https://s' || (page_id % 20) || '.example/a/' || page_id"
#: A path of its own for each hop; every other page sends it without scheme and host, as servers may.
TO = f"CASE WHEN page_id % 2 = 0 THEN '/a/' || page_id || '/' || (hop + 1) ELSE {BASE} || '/' || (hop + 1) END"
KIND = "CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'script' ELSE 'stylesheet' END"
THIRD = "page_id % 4 = 3"
#: (url, method, status, location, length, body, encoding, failure) of each hop that a page's resource takes, and of where it may end.
ANSWERS = f"""
SELECT page_id, {BASE} || '/' || hop AS url, method,
       CASE WHEN refused THEN 405 WHEN hop < {HOPS} THEN 301 ELSE CASE {END} WHEN 1 THEN CASE WHEN method = 'HEAD' THEN 501 ELSE 200 END WHEN 3 THEN 404 WHEN 4 THEN 503 WHEN 6 THEN NULL WHEN 7 THEN 302 WHEN 8 THEN 307 ELSE 200 END END AS status,
       CASE WHEN refused THEN NULL WHEN hop < {HOPS} THEN {TO} WHEN {END} = 7 THEN {BASE} || '/0' WHEN {END} = 8 THEN 'https://cdn.example/' || page_id END AS location,
       CASE WHEN hop = {HOPS} AND ({END} NOT IN (1, 2)) THEN CASE WHEN method = 'GET' AND {END} = 5 THEN 3000 + page_id ELSE 9000 + page_id END END AS length,
       CASE WHEN hop = {HOPS} AND method = 'GET' THEN 100 + page_id END AS body, CASE WHEN {END} = 5 AND method = 'GET' THEN 'gzip' END AS encoding, CASE WHEN hop = {HOPS} AND {END} = 6 THEN 'timeout' END AS failure
FROM (SELECT *, method = 'HEAD' AND page_id % 5 = 0 AND hop = 0 AS refused FROM asked)
UNION ALL SELECT page_id, 'https://cdn.example/' || page_id, method, 200, NULL, 50, NULL, NULL, NULL FROM asked WHERE hop = 0 AND {END} = 8 AND method = 'HEAD'
"""


def asset_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource per page behind 0 to 12 redirects, with all ways in which its probe may end."""
    raw = O.raw(spark, sf_dir).select("page_id")
    hops = raw.select("page_id", F.explode(F.sequence(F.lit(0), F.expr(HOPS).cast("int"))).alias("hop"))
    asked = hops.select("page_id", "hop", F.explode(F.array(F.lit("HEAD"), F.lit("GET"))).alias("method"))
    said = spark.sql(ANSWERS.replace("FROM asked", "FROM {asked}"), asked=asked)
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("location", "location"), ("content-length", "length"), ("content-encoding", "encoding"))]), lambda e: e["v"].isNotNull())
    web = kept(said.select("url", "method", F.col("status").cast("int").alias("status"), F.map_from_entries(entries).alias("headers"), "failure", F.col("body").cast("bigint").alias("bytes")), "web")
    rows = raw.select("page_id", F.expr(f"{BASE} || '/0' AS url"), F.expr(f"{KIND} AS kind"), F.expr(f"{THIRD} AS third_party"))
    got = probes.walked(rows, web, F.col("third_party"), F.col("kind") != "image")
    return got.select("page_id", F.col("status").cast("bigint").alias("status"), "failure", "bytes", "content_encoding", "final_url", F.col("hops").cast("bigint").alias("hops"), F.col("requests").cast("bigint").alias("requests"))


SITE, HOST = "'https://s' || page_id || '.example'", "'s' || page_id || '.example'"
PLAIN = "page_id % 11"
#: Where http:// of a site leads: to https, to http again (so often), off the site, to a relative path, to nothing.
ORIGIN_ANSWERS = f"""
SELECT 'http://' || {HOST} || '/' AS url, CASE {PLAIN} WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN 404 WHEN 4 THEN 308 WHEN 5 THEN 301 WHEN 6 THEN 304 WHEN 7 THEN NULL WHEN 8 THEN 301 WHEN 9 THEN 204 ELSE 301 END AS status,
       CASE {PLAIN} WHEN 1 THEN 'https://www.' || {HOST} || '/' WHEN 2 THEN '/a' WHEN 4 THEN 'https://other.example/' WHEN 5 THEN '/no/x' WHEN 8 THEN '//' || {HOST} || '/b' WHEN 10 THEN 'mailto:x' END AS location FROM pages
UNION ALL SELECT 'http://' || {HOST} || '/a', 301, CASE WHEN page_id % 2 = 0 THEN 'https://' || {HOST} || '/a' ELSE '/a2' END FROM pages
UNION ALL SELECT 'http://' || {HOST} || '/a2', 301, CASE WHEN page_id % 3 = 0 THEN '/a3' ELSE {SITE} || '/' END FROM pages
UNION ALL SELECT 'http://' || {HOST} || '/no/x', 200, NULL FROM pages
UNION ALL SELECT 'http://' || {HOST} || '/b', 200, NULL FROM pages
UNION ALL SELECT 'https://www.' || {HOST} || '/', CASE page_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 301 WHEN 5 THEN 204 ELSE NULL END, CASE page_id % 7 WHEN 1 THEN '//' || {HOST} || '/' WHEN 2 THEN 'https://other.example/' WHEN 4 THEN '/here' END FROM pages
UNION ALL SELECT {SITE} || '/gone', CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 302 WHEN 4 THEN 302 ELSE NULL END, CASE page_id % 6 WHEN 3 THEN '/' WHEN 4 THEN 'https://other.example/' END FROM pages
UNION ALL SELECT {SITE} || '/', 200, NULL FROM pages
UNION ALL SELECT {SITE} || '/favicon.ico', CASE page_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 503 ELSE NULL END, CASE WHEN page_id % 5 = 2 THEN '/i.ico' END FROM pages
UNION ALL SELECT {SITE} || '/i.ico', 200, NULL FROM pages
"""
RULES = "CASE page_id % 4 WHEN 1 THEN '/no' WHEN 2 THEN '/favicon' WHEN 3 THEN '/gone' END"


def origin_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site per page, over all endings of its probes: plain HTTP, the sibling host, a path that can't exist, and the icon."""
    raw = O.raw(spark, sf_dir).select("page_id")
    said = spark.sql(ORIGIN_ANSWERS.replace("FROM pages", "FROM {pages}"), pages=raw)
    headers = F.when(F.col("location").isNotNull(), F.create_map(F.lit("location"), F.col("location"))).otherwise(F.create_map().cast("map<string,string>"))
    web = kept(said.select("url", F.lit("GET").alias("method"), F.col("status").cast("int").alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("failure"), F.lit(1).cast("bigint").alias("bytes")), "web")
    own = raw.select(F.col("page_id").cast("string").alias("site_id"), F.expr(f"{SITE} || CASE WHEN page_id % 17 = 0 THEN ':8443' ELSE '' END AS origin"), F.expr(f"{RULES} AS rule"))
    sites = kept(own.select("site_id", "origin"), "sites")
    rules = kept(robots.parsed(own.where("rule is not null").select("site_id", F.concat(F.lit("User-agent: *\nDisallow: "), "rule").alias("text"))), "robots")
    got = probes.http_variant(sites, web, rules).join(probes.sibling(sites, web), "site_id").join(probes.soft_missing(sites, web, rules, path="/gone"), "site_id")
    pages = sites.select("site_id", F.named_struct(F.lit("icon_link"), F.col("site_id").cast("bigint") % 10 == 9).alias("doc"))
    got = got.join(probes.favicon(pages, sites, web, rules), "site_id")
    return got.select(F.col("site_id").cast("bigint").alias("page_id"), "http_to_https", "sibling_redirects", "soft404", "favicon")


QUERIES = {f.__name__: f for f in (asset_probes, origin_probes)}
SQL = {
    "asset_probes": f"""WITH RECURSIVE asked AS (SELECT page_id, unnest(range(0, CAST({HOPS} AS BIGINT) + 1)) AS hop, method FROM pages, (SELECT unnest(['HEAD', 'GET']) AS method)),
web AS ({ANSWERS}),
w AS (
  SELECT page_id, {BASE} || '/0' AS url, 'HEAD' AS method, [{BASE} || '/0'] AS trail, 1 AS requests FROM pages
  UNION ALL
  SELECT page_id, CASE WHEN moves THEN next ELSE url END, CASE WHEN moves THEN method ELSE 'GET' END, CASE WHEN moves THEN list_append(trail, next) ELSE trail END, requests + 1 FROM (
    SELECT w.*, web.status IN (301, 302, 307) AS moves, CASE WHEN web.location LIKE '/%' THEN regexp_extract(w.url, '^https://[^/]+') || web.location ELSE web.location END AS next, web.status, web.length
    FROM w JOIN web USING (page_id, url, method))
  WHERE (moves AND len(trail) <= 10 AND NOT list_contains(trail, next) AND NOT ({THIRD} AND regexp_extract(url, '^https://[^/]+') != regexp_extract(next, '^https://[^/]+')))
     OR (NOT moves AND method = 'HEAD' AND (status IN (405, 501) OR (status < 400 AND length IS NULL)))),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY requests DESC) = 1),
e AS (SELECT l.*, web.status, web.length, web.body, web.encoding, web.failure, web.status IN (301, 302, 307) AS stuck, CASE WHEN web.location LIKE '/%' THEN {BASE} || '/' || (page_id % 13 + 1) ELSE web.location END AS next, web.u IS NOT NULL AS held FROM l LEFT JOIN (SELECT page_id AS p, url AS u, method AS m, status, location, length, body, encoding, failure FROM web) web ON p = l.page_id AND u = l.url AND m = l.method),
x AS (SELECT *, coalesce(method = 'HEAD' AND status = 200 AND {KIND} != 'image' AND encoding IS NULL AND length > 1024, false) AS third_request FROM e)
SELECT x.page_id, CASE WHEN NOT coalesce(stuck, false) THEN CASE WHEN third_request AND g.status = 200 THEN CAST(g.status AS BIGINT) ELSE CAST(x.status AS BIGINT) END END AS status,
       CASE WHEN NOT held THEN 'other' WHEN x.failure IS NOT NULL THEN x.failure WHEN stuck THEN CASE WHEN len(trail) > 10 THEN 'too-many-redirects' WHEN next LIKE 'https://cdn%' THEN 'other' ELSE 'redirect-loop' END END AS failure,
       CASE WHEN stuck OR x.status IS NULL OR x.status >= 400 THEN NULL WHEN third_request AND g.status = 200 THEN CAST(coalesce(g.length, x.length) AS BIGINT) WHEN method = 'HEAD' THEN CAST(x.length AS BIGINT) ELSE CAST(x.body AS BIGINT) END AS bytes,
       CASE WHEN stuck OR x.status IS NULL THEN NULL WHEN third_request AND g.status = 200 THEN g.encoding ELSE x.encoding END AS content_encoding, x.url AS final_url, CAST(len(trail) - 1 AS BIGINT) AS hops, CAST(requests + third_request::INT AS BIGINT) AS requests
FROM x LEFT JOIN (SELECT page_id, url, status, length, encoding FROM web WHERE method = 'GET') g ON g.page_id = x.page_id AND g.url = x.url""",
    "origin_probes": """SELECT page_id,
       CASE WHEN page_id % 17 = 0 THEN NULL ELSE CASE page_id % 11 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN CASE WHEN page_id % 2 = 0 OR page_id % 3 != 0 THEN true END WHEN 5 THEN CASE WHEN page_id % 4 != 1 THEN false END WHEN 8 THEN false WHEN 9 THEN false END END AS http_to_https,
       CASE WHEN page_id % 17 = 0 THEN NULL ELSE CASE page_id % 7 WHEN 0 THEN false WHEN 1 THEN true END END AS sibling_redirects,
       CASE WHEN page_id % 17 = 0 OR page_id % 4 = 3 THEN NULL ELSE CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END END AS soft404,
       CASE WHEN page_id % 10 = 9 THEN true WHEN page_id % 17 = 0 OR page_id % 4 = 2 THEN NULL ELSE CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END END AS favicon FROM pages""",
}
