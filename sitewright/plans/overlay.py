"""A crawl's facts for the `pages` table, which holds html alone: derived by arithmetic on page_id, the same in Spark and other SQL.

These facts are synthetic. They give rules something to find: status, redirects, timings, headers and sitemap membership, and
snippets of markup put into the html. Pages that a snippet goes into are told by page_id; oracles look at the markup instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources.tables import kept

IMAGES = "".join(f'<img src="/i/{k}.png"{a}>' for k, a in enumerate([' alt="one" width="1" height="1"', ' width="2" height="2"', ' alt="" height="3"', ' alt="four" width="4" height="4"', ' alt="five" width="5" height="5" loading="lazy"']))
HEAD = (
    """CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="noindex, follow">' ELSE '' END"""
    """ || CASE WHEN page_id % 3 = 0 THEN '<meta name="viewport" content="width=device-width"><meta name="description" content="A page about some things' || (page_id % 4) || '">' ELSE '' END"""
    """ || CASE WHEN page_id % 4 = 0 THEN '<script src="/s.js"></script>' ELSE '' END"""
    """ || CASE WHEN page_id % 8 = 0 THEN '<link rel="stylesheet" href="/1.css"><link rel="stylesheet" href="/2.css"><link rel="stylesheet" href="/3.css"><link rel="stylesheet" href="/4.css"><link rel="stylesheet" href="/5.css">' ELSE '' END"""
    """ || CASE WHEN page_id % 12 = 0 THEN '<script type="application/ld+json">{"@type": "Thing", </script>' WHEN page_id % 6 = 0 THEN '<script type="application/ld+json">{"@type": "Thing"}</script>' ELSE '' END"""
    """ || CASE WHEN page_id % 13 = 0 THEN '<link rel="canonical" href="https://other.example/' || page_id || '">' WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="https://site.example/p/' || page_id || '">' ELSE '' END"""
)
BODY = (
    f"""CASE WHEN page_id % 2 = 0 THEN '{IMAGES}' ELSE '' END"""
    """ || CASE WHEN page_id % 7 = 0 THEN '<input type="text" name="q"><button type="submit"></button><iframe src="/f"></iframe>' ELSE '' END"""
    """ || CASE WHEN page_id % 9 = 0 THEN '<h4>deep</h4><a href="/x">Read more.</a><a href="/y"></a>' ELSE '' END"""
    """ || CASE WHEN page_id % 10 = 0 THEN '<img src="http://plain.example/z.png" alt="z" width="1" height="1">' ELSE '' END"""
)
AUGMENTED = f"replace(replace(html, '</head>', {HEAD} || '</head>'), '</article>', {BODY} || '</article>')"
STATUS = "CASE WHEN page_id % 29 = 0 THEN NULL WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 ELSE 200 END"
FAILURE = "CASE WHEN page_id % 29 = 0 THEN 'timeout' END"
HOPS = "CASE WHEN page_id % 11 = 0 THEN 2 WHEN page_id % 7 = 0 THEN 1 ELSE 0 END"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, final_url, truncated and doc of the pages as they are."""
    return H.documents(H.parsed(raw(spark, sf_dir).withColumnRenamed("url", "final_url"), "page_id"))


def pooled(spark: SparkSession, sf_dir: str, augmented: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pages, sites) of one site that holds all pages, under addresses made of page_id, with the synthetic facts."""
    rows = raw(spark, sf_dir).select(
        F.lit("site").alias("site_id"),
        "page_id",
        F.expr("'https://site.example/p/' || page_id").alias("final_url"),
        F.expr(AUGMENTED if augmented else "html").alias("html"),
        F.octet_length("html").cast("bigint").alias("bytes"),
    )
    pages = H.documents(H.parsed(rows, "site_id", "page_id", "bytes"))
    pages = pages.select(
        "site_id", "page_id", F.col("page_id").cast("double").alias("ord"), F.col("final_url").alias("url"), "final_url", "doc", "bytes", "truncated", F.lit(True).alias("is_html"),
        F.expr(STATUS).cast("int").alias("status"), F.expr(FAILURE).alias("failure"),
        F.expr(f"transform(sequence(1, greatest(1, {HOPS})), i -> named_struct('url', 'https://site.example/h/' || page_id || '/' || i, 'status', 301, 'location', 'https://site.example/p/' || page_id))").alias("_hops"),
        F.expr("(page_id * 37) % 1600").cast("bigint").alias("response_ms"), F.expr("page_id % 2 = 0").alias("in_sitemap"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN map('content-encoding', 'gzip') ELSE map('x-powered-by', 'nothing') END").alias("headers"),
    )
    pages = pages.withColumn("hops", F.slice("_hops", F.lit(1), F.expr(HOPS))).drop("_hops")
    pages = pages.withColumn("inlinks", F.expr("CASE WHEN page_id % 4 = 1 THEN array('https://site.example/p/0') ELSE array() END").cast("array<string>"))
    site = spark.range(1).select(
        F.lit("site").alias("site_id"), F.lit("https://site.example/p/1").alias("start_url"), F.lit("https://site.example").alias("origin"), F.lit(True).alias("sitemap_found"),
        F.expr("named_struct('status', 200, 'present', true, 'disallow_all', false, 'sitemaps', cast(array() as array<string>), 'crawl_delay_ms', cast(null as bigint), 'ignored', false)").alias("robots"),
        F.expr("named_struct('http_to_https', false, 'sibling_redirects', cast(null as boolean), 'sibling_host', cast(null as string), 'soft404', true, 'favicon', false)").alias("probes"),
        F.lit(False).alias("external_checked"), F.array().cast("array<string>").alias("blocked_by_robots"),
    )
    return kept(pages, "overlay"), site
