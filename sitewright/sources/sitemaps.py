"""Sitemap files: their kind and the URLs that they list."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin, path, same_site
from ..operators.crawl import redirected, resolving
from ..operators.rules import NESTED_NOTE, SKIPPED_NOTE
from .tables import kept
from .web import looks_like_html

MAX_URLS, MAX_FILES = 5000, 5
_TAG = re.compile(r"<!\[CDATA\[(.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<!.*?>|<(/?)([^\s/>]+)[^>]*?(/?)>", re.S)


def _entities(text: str) -> str:
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(name, value)
    return text


def parse(xml: str | None, most: int = MAX_URLS) -> tuple[str, list[str]]:
    """(urlset, index or invalid; URLs): `loc` texts right below entries, with the root's prefix; in order, each once."""
    stack: list[str] = []
    kind, prefix, text, urls, at = "invalid", "", None, {}, 0
    for m in _TAG.finditer(xml or ""):
        if text is not None:
            text += _entities(xml[at : m.start()]) + (m[1] or "")
        at = m.end()
        if m[3] is None:
            continue
        before, _, local = m[3].rpartition(":")
        if m[2]:
            if text is not None and local == "loc":
                if text.strip():
                    urls.setdefault(text.strip())
                text = None
            while m[3] in stack and stack.pop() != m[3]:
                pass
            if not stack or len(urls) >= most:
                break
            continue
        if not stack:
            kind, prefix = {"urlset": "urlset", "sitemapindex": "index"}.get(local, "invalid"), before
            if kind == "invalid":
                break
        elif len(stack) == 2 and local == "loc" and before == prefix and stack[1].rpartition(":")[2] == {"urlset": "url", "index": "sitemap"}[kind]:
            text = ""
        if not m[4]:
            stack.append(m[3])
        if len(stack) > 16:
            break
    return kind, list(urls)[:most]


def _parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse(x) for x in batch.column(batch.schema.get_field_index("xml")).to_pylist()]
        keep = [k for k in batch.schema.names if k != "xml"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=[*keep, "kind", "locs"])


def parsed(files: DataFrame) -> DataFrame:
    """Files (site_id, url, xml) with kind and locs."""
    return files.select("site_id", "url", "xml").mapInArrow(_parsing, "site_id string, url string, kind string, locs array<string>")


def named(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, pos, url): Sitemap lines of robots.txt, resolved against the site's origin, each URL once."""
    rows = lines.join(sites.select("site_id", F.col("origin").alias("final_url")), "site_id").select("site_id", "pos", F.col("url").alias("_to"), "final_url")
    return rows.mapInArrow(resolving, rows.schema).where("_to is not null").groupBy("site_id", F.col("_to").alias("url")).agg(F.min("pos").alias("pos"))


def loaded(named: DataFrame, web: DataFrame, sites: DataFrame, guesses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, urls): sitemap files that robots.txt names (site_id, pos, url), indexes opened one level down, and what they list.

    `guesses` (site_id, url, allowed) are looked at besides: one that robots.txt disallows is only noted, and one that is a page
    and no sitemap isn't. At most MAX_FILES files and MAX_URLS URLs of a site count; only URLs of its origin do; .gz files and
    those of other sites are noted and not read. Redirects are followed on the site.
    """
    web = web if "failure" in web.columns else web.withColumn("failure", F.lit(None).cast("string"))
    web = web if "headers" in web.columns else web.withColumn("headers", F.create_map().cast("map<string,string>"))
    named = named.select("site_id", "pos", "url").withColumns({"guessed": F.lit(False), "barred": F.lit(False)})
    if guesses is not None:
        named = named.unionByName(guesses.select("site_id", F.lit(0).alias("pos"), "url", F.lit(True).alias("guessed"), (~F.col("allowed")).alias("barred")))
    own = sites.select("site_id", "origin")

    def opened(wanted: DataFrame) -> DataFrame:
        unread = F.when(F.col("barred"), SKIPPED_NOTE).when(~same_site(F.col("url"), F.col("origin")), "on another site, not read").when(F.lower(path(F.col("url"))).endswith(".gz"), "gzip, not read")
        wanted = kept(wanted.join(own, "site_id").withColumn("unread", unread).drop("barred"), "sitemaps")
        asked = redirected(wanted.where("unread is null"), web, lambda rows: rows.withColumn("reason", F.when(~same_site(F.col("_to"), F.col("origin")), "site")))
        page = looks_like_html(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit("")), F.col("html"))
        got = asked.withColumn("unread", F.when(F.col("reason").isNotNull(), "redirects to another site, not read").when(F.col("status").isNull(), F.coalesce(F.nullif("failure", F.lit("other")), F.lit("not fetched"))))
        got = got.select(*wanted.columns, "status", F.col("html").alias("xml"), page.alias("_page")).unionByName(wanted.where("unread is not null"), allowMissingColumns=True).drop("origin")
        got = kept(got, "sitemaps")
        kinds = parsed(got.where("status = 200")).dropDuplicates(["site_id", "url"])
        return got.drop("xml").join(kinds, ["site_id", "url"], "left")

    def first(rows: DataFrame, room: Column) -> DataFrame:
        """Of each site's files the first ones by place, as many as there is room for: no more are read."""
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("site_id").orderBy("pos", "url"))).where(F.col("_rank") <= room).drop("_rank")

    # a guess that turns out to be a page leaves room for one more
    top = opened(first(named, F.lit(MAX_FILES + 1)).withColumn("level", F.lit(0)))
    top = top.where(~(F.col("guessed") & F.col("status").eqNullSafe(200) & F.col("kind").eqNullSafe("invalid") & F.coalesce("_page", F.lit(False))))
    inner = top.where("kind = 'index'").select("site_id", (F.col("pos") * 10_000).alias("_base"), F.posexplode("locs").alias("_k", "url")).select("site_id", "url", (F.col("_base") + F.col("_k") + 1).cast("int").alias("pos"), F.lit(1).alias("level"), F.lit(False).alias("guessed"), F.lit(False).alias("barred"))
    inner = first(inner.join(top.groupBy("site_id").agg(F.count(F.lit(1)).alias("_top")), "site_id"), F.lit(MAX_FILES) - F.col("_top")).drop("_top")
    both = top.unionByName(opened(inner))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("level", "pos", "url"))).where(F.col("rank") <= MAX_FILES)
    note = F.when(F.col("unread").isNotNull(), F.col("unread")).when(F.col("status") != 200, F.concat(F.lit("status "), F.col("status").cast("string"))).when(F.col("kind") == "invalid", "not a sitemap").when((F.col("kind") == "index") & (F.col("level") == 1), NESTED_NOTE)
    files = ranked.select("site_id", (F.col("rank") - 1).alias("pos"), "url", "status", F.coalesce(note.isNull(), F.lit(False)).alias("ok"), note.alias("note"))
    locs = ranked.where("kind = 'urlset'").select("site_id", F.col("rank").alias("_file"), F.posexplode("locs").alias("_k", "url")).join(own, "site_id").where(origin(F.col("url")) == F.col("origin"))
    one = locs.groupBy("site_id", "url").agg(F.min(F.struct("_file", "_k")).alias("at"))
    urls = one.withColumn("pos", F.row_number().over(Window.partitionBy("site_id").orderBy("at")) - 1).where(F.col("pos") < MAX_URLS).select("site_id", "pos", "url")
    return files, urls
