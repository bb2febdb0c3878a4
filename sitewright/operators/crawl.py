"""A crawl over captured answers: breadth-first, level by level, for many sites at once.

`web` (url, method, status, headers, body, failure, html, ...) stands in for the network. Each level is a join of the frontier with
it; visited URLs are kept out by an anti-join; results of a level are added to tables that only grow, so lineage stays short and a level
costs what it finds. Hops are walked over status and headers alone; a body is read where a walk ends.
Order is that of one worker: links in page order, so caps fall the same way each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_html_type
from ..functions.urls import excluded, normalised, path_with_query, same_origin
from ..sources.tables import Growing, kept
from . import robots

MAX_HOPS = 10
REDIRECTS = (301, 302, 303, 307, 308)


def _kept(df: DataFrame) -> DataFrame:
    return kept(df, "crawl")


def depths(links: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(site_id, node, depth) of nodes within `max_depth` links (site_id, source, target) of the start nodes (site_id, node), or of all that links lead to.

    A level reads the links of its frontier and the nodes seen so far, and adds what is new to them.
    """
    seen = Growing(start.sparkSession, "crawl-depths")
    frontier, depth = _kept(start.select("site_id", "node", F.lit(0).alias("depth")).distinct()), 0
    while not frontier.isEmpty():
        seen.add(frontier)
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        reached = links.join(frontier.select("site_id", F.col("node").alias("source")), ["site_id", "source"]).select("site_id", F.col("target").alias("node")).distinct()
        frontier = _kept(reached.join(seen.df, ["site_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
    return seen.df if seen.schema else frontier


def resolving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Location headers (_to) resolved against the URL that sent them."""
    for batch in batches:
        at = batch.schema.get_field_index
        to, base = batch.column(at("_to")).to_pylist(), batch.column(at("final_url")).to_pylist()
        yield batch.set_column(at("_to"), "_to", pa.array([None if x is None else normalised(x, y) for x, y in zip(to, base, strict=True)], pa.string()))


def redirected(urls: DataFrame, web: DataFrame, verdict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """urls (site_id, url, ...) with final_url, status, failure, hops, reason and the last answer's headers and html.

    Redirects are followed hop by hop, by a join of the rows that still move, for MAX_HOPS hops at most; one that leads back to
    where it has been is a loop. `verdict` adds `reason` to rows (site_id, _to, ...): where it isn't null, the hop isn't requested,
    the row keeps the status of the redirect, and it has failed only if robots.txt is the reason.
    """
    answers = web.select(F.col("url").alias("_u"), F.col("status").alias("_status"), F.col("headers").alias("_headers"), F.col("failure").alias("_failure"))
    text, none = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    at = urls.withColumn("final_url", F.col("url")).withColumn("hops", F.array().cast("array<struct<url:string,status:int,location:string>>"))
    done: list[DataFrame] = []

    def settled(rows: DataFrame, status: Column, failure: Column, headers: Column = none, reads: Column = F.lit(None).cast("string"), reason: Column = text) -> None:
        done.append(rows.select(*urls.columns, "final_url", "hops", status.cast("int").alias("status"), failure.alias("failure"), reason.alias("reason"), headers.alias("headers"), reads.alias("_reads")))

    for hop in range(MAX_HOPS + 1):
        asked = at.join(answers, F.col("final_url") == F.col("_u"), "left")
        to = F.try_element_at("_headers", F.lit("location"))
        moves = F.coalesce(F.col("_status").isin(*REDIRECTS) & to.isNotNull(), F.lit(False))
        failure = F.when(F.col("_u").isNull(), "other").otherwise(F.col("_failure"))
        settled(asked.where(~moves), F.when(failure.isNull(), F.col("_status")), failure, F.coalesce("_headers", none), F.col("final_url"))
        turned = asked.where(moves).select(*urls.columns, "final_url", "hops", F.col("_status").alias("_from"), to.alias("_to"))
        if hop == MAX_HOPS:
            settled(turned, F.lit(None), F.lit("too-many-redirects"))
            break
        turned = _kept(turned.mapInArrow(resolving, turned.schema))
        if turned.isEmpty():
            break
        settled(turned.where("_to is null"), F.lit(None), F.lit("other"))
        been = (F.col("_to") == F.col("url")) | F.exists("hops", lambda h: h["location"] == F.col("_to"))
        led = turned.where("_to is not null").withColumn("_been", been).withColumn("hops", F.concat("hops", F.array(F.struct(F.col("final_url").alias("url"), F.col("_from").alias("status"), F.col("_to").alias("location")))))
        settled(led.where("_been"), F.lit(None), F.lit("redirect-loop"))
        onward = led.where("not _been").withColumn("final_url", F.col("_to"))
        if verdict:
            judged = verdict(onward)
            settled(judged.where("reason is not null"), F.col("_from"), F.when(F.col("reason") == "robots", "blocked-by-robots"), reason=F.col("reason"))
            onward = judged.where("reason is null")
        at = _kept(onward.select(*urls.columns, "final_url", "hops"))
        if at.isEmpty():
            break
    # hops are walked without bodies; each is read once, for the rows that end there
    bodies = web.select(F.col("url").alias("_reads"), "html")
    return reduce(DataFrame.unionByName, done).join(bodies, "_reads", "left").drop("_reads")


def _split(got: DataFrame, seen: DataFrame | None) -> DataFrame:
    """A redirected URL keeps its hops and no document; where it led is a page of its own, unless that is known already."""
    own = got.withColumn("doc", F.when(F.size("hops") == 0, F.col("doc")))
    led = got.where((F.size("hops") > 0) & F.col("failure").isNull() & F.col("reason").isNull()).withColumn("url", F.col("final_url")).withColumn("hops", F.slice("hops", 1, 0)).withColumn("ord", F.col("ord") + 0.5).withColumn("counted", F.lit(None).cast("boolean"))
    new = led.where(same_origin(F.col("url"), F.col("site_origin"))).join(got.select("site_id", "url"), ["site_id", "url"], "left_anti")
    new = new if seen is None else new.join(seen, ["site_id", "url"], "left_anti")
    first = new.groupBy("site_id", "url").agg(F.min("ord").alias("ord"))
    return own.unionByName(new.join(first, ["site_id", "url", "ord"]).dropDuplicates(["site_id", "url"]))


def crawled(sites: DataFrame, web: DataFrame, rules: DataFrame, sitemap_urls: DataFrame, extract, token: str = "sitewright", max_pages: int = 50, max_depth: int = 3, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, blocked, uncrawled): pages of each site as the audit wants them, URLs (site_id, url) that robots.txt forbids, and
    how many URLs (site_id, n) were left when a site's limit was reached.

    `extract` turns rows with final_url and html into rows with doc, e.g. `sources.html`. Links of a page at depth d are at d + 1;
    URLs that only the sitemap names come last, and their links aren't followed. Answers that aren't HTML count as resources, all
    else as pages; a site stops when either count is `max_pages`.
    """
    own = sites.select("site_id", "start_url", F.col("origin").alias("site_origin"))
    start = own.select("site_id", F.col("start_url").alias("url"), F.lit(0).alias("depth"), F.struct(F.lit(0.0).alias("ord"), F.lit(0).alias("pos")).alias("at"), F.lit(False).alias("from_sitemap"))
    listed, blocked, spent_by, left = sitemap_urls.select("site_id", "url").distinct(), None, None, None
    seen, pages = Growing(sites.sparkSession, "crawl-seen"), Growing(sites.sparkSession, "crawl-pages")
    frontier, level, base = start, 0, 0.0

    def verdict(rows: DataFrame) -> DataFrame:
        """Why a redirect's target isn't requested: another origin, an excluded path, or robots.txt."""
        decided = robots.decisions(rows.withColumn("path", path_with_query(F.col("_to"))), rules, token)
        return decided.withColumn("reason", F.when(~same_origin(F.col("_to"), F.col("site_origin")), "origin").when(excluded(F.col("_to"), list(exclude)), "excluded").when(~F.col("allowed"), "robots")).drop("path", "allowed")

    while True:
        named = frontier.join(own.select("site_id", "site_origin"), "site_id").where(same_origin(F.col("url"), F.col("site_origin")) & ~excluded(F.col("url"), list(exclude))).withColumn("path", path_with_query(F.col("url")))
        decided = _kept(robots.decisions(named, rules, token).drop("path"))
        barred = decided.where(~F.col("allowed")).select("site_id", "url")
        allowed = decided.where("allowed").drop("allowed")
        # of a level, twice the limit is more than one site can take: no more is ranked
        rank = F.row_number().over(Window.partitionBy("site_id").orderBy("at", "url"))
        ranked = allowed.withColumn("_rank", rank).where(F.col("_rank") <= 2 * max_pages).withColumn("ord", F.lit(base) + F.col("_rank"))
        used = ranked if spent_by is None else ranked.join(spent_by, "site_id", "left")
        spent = lambda c: F.lit(0) if spent_by is None else F.coalesce(c, F.lit(0))
        taken = used.where((spent("_pages") < max_pages) & (spent("_others") < max_pages))
        got = extract(redirected(taken.drop("_pages", "_others", "at"), web, verdict).withColumn("is_html", is_html_type(F.try_element_at("headers", F.lit("content-type")))))
        got = got.withColumn("counted", ~(F.col("reason").isNull() & F.col("status").isNotNull() & ~F.col("is_html")))
        before = Window.partitionBy("site_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        room = got if spent_by is None else got.join(used.select("site_id", "_pages", "_others").distinct(), "site_id", "left")
        n_before = lambda c, flag: F.coalesce(F.sum(flag.cast("int")).over(before), F.lit(0)) + spent(c)
        room = room.withColumn("_p", n_before("_pages", F.col("counted"))).withColumn("_o", n_before("_others", ~F.col("counted")))
        got = _kept(_split(room.where((F.col("_p") < max_pages) & (F.col("_o") < max_pages)).drop("_p", "_o", "_pages", "_others", "_rank"), seen.df if seen.schema else None))
        rest = allowed.select("site_id", "url").join(got.select("site_id", "url"), ["site_id", "url"], "left_anti").groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
        left = rest if left is None else left.unionByName(rest)
        led = got.where("reason = 'robots'").select("site_id", F.col("final_url").alias("url"))
        blocked = barred.unionByName(led) if blocked is None else blocked.unionByName(barred).unionByName(led)
        pages.add(got)
        seen.add(decided.select("site_id", "url").unionByName(got.select("site_id", "url")).distinct())
        spent_now = got.where("counted is not null").groupBy("site_id").agg(F.count_if("counted").alias("_pages"), F.count_if(~F.col("counted")).alias("_others"))
        spent_by = _kept(spent_now if spent_by is None else spent_by.unionByName(spent_now).groupBy("site_id").agg(F.sum("_pages").alias("_pages"), F.sum("_others").alias("_others")))
        level += 1
        links = got.where("not from_sitemap").select("site_id", F.col("ord"), F.posexplode("doc.links").alias("pos", "_link")).where("_link.url is not null")
        if level <= max_depth:
            base = level * 1e6
            found = links.groupBy("site_id", F.col("_link.url").alias("url")).agg(F.min(F.struct("ord", "pos")).alias("at"))
            frontier = _kept(found.join(seen.df, ["site_id", "url"], "left_anti").select("site_id", "url", F.lit(level).alias("depth"), "at", F.lit(False).alias("from_sitemap")))
            if not frontier.isEmpty():
                continue
        base = 1e12
        more = sitemap_urls.select("site_id", "url", "pos").join(seen.df, ["site_id", "url"], "left_anti")
        frontier = _kept(more.select("site_id", "url", F.lit(None).cast("int").alias("depth"), F.struct(F.lit(0.0).alias("ord"), "pos").alias("at"), F.lit(True).alias("from_sitemap")))
        if frontier.isEmpty():
            break
        level = max_depth + 1
        sitemap_urls = sitemap_urls.limit(0)
    out = pages.df.drop("counted", "reason").join(listed.withColumn("in_sitemap", F.lit(True)), ["site_id", "url"], "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False)) | F.col("from_sitemap"))
    return out, blocked.distinct(), left.groupBy("site_id").agg(F.sum("n").alias("n"))
