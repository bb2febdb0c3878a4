"""The sets of pages that rules look at. All frames are keyed by site_id; one run audits many sites.

pages: site_id, ord, url, final_url, hops, status, failure, depth, from_sitemap, in_sitemap, headers, response_ms, total_ms, bytes,
transfer_bytes, truncated, is_html, doc, inlinks. sites: site_id, start_url, origin, robots, sitemap_found, probes,
external_checked, limits, blocked_by_robots. Columns that a run lacks are added as nulls by `complete`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin

HOPS = "array<struct<url:string,status:int,location:string>>"
PAGE_COLUMNS = {
    "site_id": "string", "ord": "double", "url": "string", "final_url": "string", "hops": HOPS, "status": "int", "failure": "string", "depth": "int", "from_sitemap": "boolean",
    "in_sitemap": "boolean", "headers": "map<string,string>", "response_ms": "bigint", "total_ms": "bigint", "bytes": "bigint", "transfer_bytes": "bigint", "truncated": "boolean", "is_html": "boolean", "inlinks": "array<string>",
}
SITE_COLUMNS = {
    "site_id": "string", "start_url": "string", "origin": "string", "robots": "struct<status:int,present:boolean,disallow_all:boolean,sitemaps:array<string>,crawl_delay_ms:bigint,ignored:boolean>",
    "sitemap_found": "boolean", "probes": "struct<http_to_https:boolean,sibling_redirects:boolean,sibling_host:string,soft404:boolean,favicon:boolean>", "external_checked": "boolean",
    "limits": "struct<max_pages:int,max_depth:int,pages_crawled:int,uncrawled:int,assets_not_measured:int,delay_raised:boolean>", "blocked_by_robots": "array<string>",
}
ASSET_COLUMNS = {
    "site_id": "string", "pos": "int", "url": "string", "kind": "string", "third_party": "boolean", "status": "int", "bytes": "bigint", "content_type": "string", "content_encoding": "string", "cache_control": "string", "measured": "boolean", "used_by": "array<string>",
}
FILE_COLUMNS = {"site_id": "string", "pos": "int", "url": "string", "status": "int", "ok": "boolean", "note": "string"}
SITEMAP_URL_COLUMNS = {"site_id": "string", "pos": "int", "url": "string"}
EXTERNAL_COLUMNS = {"site_id": "string", "pos": "int", "url": "string", "status": "int", "failure": "string", "used_by": "array<string>"}


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of the schema that are missing, as nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def empty(like: DataFrame, columns: dict[str, str]) -> DataFrame:
    return like.sparkSession.createDataFrame([], ", ".join(f"`{k}` {v}" for k, v in columns.items()))


def noindex() -> Column:
    return F.arrays_overlap(F.coalesce("doc.meta_robots", F.array().cast("array<string>")), F.array(F.lit("noindex"), F.lit("none")))


def with_views(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with their site's start_url and origin, and the flags is_page (an HTML page of the site), indexable and requested."""
    own = sites.select("site_id", F.col("start_url").alias("site_start"), F.col("origin").alias("site_origin"))
    joined = complete(pages, PAGE_COLUMNS).join(own, "site_id")
    is_page = (F.col("status") == 200) & F.coalesce("is_html", F.lit(False)) & F.col("doc").isNotNull() & (origin(F.col("final_url")) == F.col("site_origin"))
    return (
        joined.withColumn("is_page", F.coalesce(is_page, F.lit(False)))
        .withColumn("indexable", F.col("is_page") & ~noindex())
        .withColumn("requested", ~F.col("failure").eqNullSafe("blocked-by-robots"))
        .withColumn("is_start", (F.col("url") == F.col("site_start")) | (F.col("final_url") == F.col("site_start")))
    )
