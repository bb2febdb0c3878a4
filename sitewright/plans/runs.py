"""A whole run over captured answers: from start URLs alone, sites are opened, crawled, probed and audited, many at once.

`web` (url, method, status, headers, failure, html, and bytes or body) stands in for the network, as in `operators.crawl`: what it
doesn't hold could not be fetched. robots.txt files are known by their origin, as a start URL may move a site to another one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import excluded, hostname, origin, path_with_query, same_site
from ..operators import crawl, graph, probes, robots
from ..operators import views as V
from ..sources import html, sitemaps
from ..sources.tables import kept
from .audit import Audit, Options, audit

#: A start URL may move a site so often to its sibling host or another scheme, and once to another site.
MAX_SHIFTS = 3
NOT_SEEN = ("what scripts draw", "pages behind a login", "how fast the site is for its visitors", "contrast, keyboard use and screen readers", "anything beyond the limit of pages")


@dataclass(frozen=True)
class Run:
    """What was opened (site_id, requested, url, origin, hops, problem), and the audit of the sites without a problem."""

    opened: DataFrame
    audit: Audit


def robots_files(web: DataFrame) -> DataFrame:
    """(site_id, status, why, text) of each origin's robots.txt, redirects on the same site followed; `why` says why a file can't be read."""
    asked = web.where(F.col("url").rlike(r"^https?://[^/?#]+/robots\.txt$")).select(origin(F.col("url")).alias("site_id"), "url")
    got = crawl.redirected(asked, web, lambda rows: rows.withColumn("reason", F.when(~same_site(F.col("_to"), F.col("site_id")), "origin")))
    why = F.when(F.col("reason").isNotNull(), "it redirects to another site").when(F.col("status").isNull(), F.coalesce("failure", F.lit("other"))).when(F.col("status") >= 500, T.said("status ", F.col("status")))
    return got.select("site_id", "status", why.alias("why"), F.when(why.isNull() & F.col("status").between(200, 299), robots.readable(F.col("html"))).alias("text"))


def _judged(rows: DataFrame, rules: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """Rows (site_id, url, at_origin) with what the robots.txt of at_origin says: allowed, and why it can't be read."""
    by_origin = rows.withColumnRenamed("site_id", "_site").withColumn("site_id", F.col("at_origin")).withColumn("path", path_with_query(F.col("url")))
    known = files.select("site_id", F.struct("why").alias("_file"))
    out = robots.decisions(by_origin, rules, token).join(known, "site_id", "left")
    return out.withColumn("why", F.when(F.col("_file").isNull(), "other").otherwise(F.col("_file.why"))).drop("site_id", "path", "_file").withColumnRenamed("_site", "site_id")


def opened(starts: DataFrame, web: DataFrame, files: DataFrame, rules: DataFrame, o: Options) -> DataFrame:
    """(site_id, requested, url, origin, hops, problem): where each start URL (site_id, start_url) leads, and why a site can't be audited.

    Each hop is judged before it is asked for, by excluded paths and by the robots.txt of the origin that it is on. A hop to
    another origin moves the site there: MAX_SHIFTS times on the site that was named, and once to another.
    """
    raw = starts.select("site_id", F.col("start_url").alias("_to"), F.lit(None).cast("string").alias("final_url"))
    first = raw.mapInArrow(crawl.resolving, raw.schema).select("site_id", F.col("_to").alias("requested"))
    none = F.array().cast(V.HOPS)
    at = first.select("site_id", "requested", origin(F.col("requested")).alias("home"), F.col("requested").alias("url"), origin(F.col("requested")).alias("at_origin"), F.lit(0).alias("shifts"), F.lit(False).alias("moved"), F.array(F.col("requested")).alias("trail"), none.alias("hops"))
    columns, done = at.columns, []
    answers = web.select(F.col("url").alias("_u"), F.col("status").alias("_status"), F.col("failure").alias("_failure"), F.try_element_at("headers", F.lit("location")).alias("_to"), F.try_element_at("headers", F.lit("content-type")).alias("_type"))

    def settled(rows: DataFrame, problem: Column) -> None:
        done.append(rows.select("site_id", "requested", "url", F.col("at_origin").alias("origin"), "hops", problem.alias("problem")))

    settled(at.where("requested is null"), F.lit("The start URL is no http or https URL."))
    at = at.where("requested is not null")
    unreached = lambda c: T.said("The start URL can't be reached (", c, ").")
    for _ in range((MAX_SHIFTS + 2) * (crawl.MAX_HOPS + 1)):
        judged = _judged(at, rules, files, o.user_agent)
        heeded = F.lit(not o.ignore_robots)
        barred = F.when((F.size("hops") > 0) & excluded(F.col("url"), list(o.exclude)), T.said("The start URL redirects to ", F.col("url"), ", which is excluded.")).when(heeded & F.col("why").isNotNull(), T.said("robots.txt of ", F.col("at_origin"), " can't be read (", F.col("why"), ").")).when(heeded & ~F.col("allowed"), T.said("robots.txt disallows ", F.col("url"), "."))
        judged = judged.withColumn("_barred", barred)
        settled(judged.where("_barred is not null"), F.col("_barred"))
        asked = judged.where("_barred is null").select(*columns).join(answers, F.col("url") == F.col("_u"), "left")
        moves = F.coalesce(F.col("_status").isin(*crawl.REDIRECTS) & F.col("_to").isNotNull(), F.lit(False))
        problem = F.when(F.col("_u").isNull() | F.col("_status").isNull(), unreached(F.coalesce("_failure", F.lit("other")))).when(F.col("_status") >= 400, T.said("The start URL answers with status ", F.col("_status"), ".")).when(~T.is_html_type(F.coalesce("_type", F.lit(""))), T.said("The start URL is no HTML page (", F.coalesce("_type", F.lit("unknown type")), ")."))
        settled(asked.where(~moves), problem)
        turned = asked.where(moves).withColumn("final_url", F.col("url")).select(*columns, "_status", "_to", "final_url")
        turned = kept(turned.mapInArrow(crawl.resolving, turned.schema), "open").withColumn("_other", F.coalesce(origin(F.col("_to")) != F.col("at_origin"), F.lit(False))).withColumn("_home", same_site(F.col("_to"), F.col("home")))
        if turned.isEmpty():
            break
        refused = F.col("_other") & F.when(F.col("_home"), F.col("shifts") >= MAX_SHIFTS).otherwise(F.col("moved"))
        stop = F.when(F.col("_to").isNull(), unreached(F.lit("other"))).when(F.array_contains("trail", F.col("_to")), unreached(F.lit("redirect-loop"))).when(F.size("trail") > crawl.MAX_HOPS, unreached(F.lit("too-many-redirects"))).when(refused, T.said("The start URL redirects over several hosts; it isn't followed to ", F.col("_to"), "."))
        turned = turned.withColumn("_stop", stop)
        settled(turned.where("_stop is not null"), F.col("_stop"))
        hop = F.struct(F.col("url").alias("url"), F.col("_status").alias("status"), F.col("_to").alias("location"))
        onward = turned.where("_stop is null").select(
            "site_id", "requested", "home", F.col("_to").alias("url"), F.when(F.col("_other"), origin(F.col("_to"))).otherwise(F.col("at_origin")).alias("at_origin"), (F.col("shifts") + (F.col("_other") & F.col("_home")).cast("int")).alias("shifts"), (F.col("moved") | (F.col("_other") & ~F.col("_home"))).alias("moved"),
            F.when(F.col("_other"), F.array("_to")).otherwise(F.array_append("trail", F.col("_to"))).alias("trail"), F.array_append("hops", hop).alias("hops"),
        )
        at = kept(onward, "open")
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _assets(pages: DataFrame, web: DataFrame, sites: DataFrame, rules: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(assets, barred): resources, the first `max_assets` of those that may be asked for measured; and those that robots.txt forbids."""
    named = graph.assets(pages).join(sites.select("site_id", hostname(F.col("origin")).alias("_host")), "site_id").withColumn("path", path_with_query(F.col("url")))
    # the site's own host under another scheme or port keeps to the site's rules too
    judged = robots.decisions(named, rules, o.user_agent).withColumn("_own", ~F.col("third_party") | (F.lit(o.external) & (hostname(F.col("url")) == F.col("_host"))))
    may = F.when(F.col("_own"), F.col("allowed") & ~excluded(F.col("url"), list(o.exclude))).otherwise(F.lit(o.external))
    judged = kept(judged.withColumn("_may", may), "assets")
    ranked = judged.where("_may").withColumn("_rank", F.row_number().over(Window.partitionBy("site_id").orderBy("pos")))
    chosen = ranked.where(F.col("_rank") <= o.max_assets)
    columns = ["site_id", "pos", "url", "kind", "third_party", "used_by"]
    left = judged.join(chosen.select("site_id", "pos"), ["site_id", "pos"], "left_anti").select(*columns, F.lit(False).alias("measured"))
    got = probes.measured(chosen.select(*columns), web, sites, rules, o.user_agent, o.exclude)
    return got.unionByName(left, allowMissingColumns=True), judged.where("_own and not allowed").select("site_id", "url")


def _external(pages: DataFrame, web: DataFrame, sites: DataFrame, rules: DataFrame, o: Options) -> DataFrame:
    """Links to other origins with what they answered: to HEAD, or to GET where HEAD is refused."""
    answer = lambda m: web.where(F.col("method") == m).select(F.col("url").alias("_u"), F.struct("status", "failure").alias(m.lower()))
    links = graph.external_links(pages).join(sites.select("site_id", hostname(F.col("origin")).alias("_host")), "site_id").withColumn("path", path_with_query(F.col("url")))
    judged = robots.decisions(links, rules, o.user_agent).withColumn("_own", F.coalesce(hostname(F.col("url")) == F.col("_host"), F.lit(False)))
    for m in ("HEAD", "GET"):
        judged = judged.join(answer(m), F.col("url") == F.col("_u"), "left").drop("_u")
    by_get = F.col("head").isNull() | F.coalesce(F.col("head.status").isin(405, 501), F.lit(False))
    got = F.when(by_get, F.col("get")).otherwise(F.col("head"))
    barred, left_out = F.col("_own") & ~F.col("allowed"), F.col("_own") & excluded(F.col("url"), list(o.exclude))
    failure = F.when(barred, "blocked-by-robots").when(left_out, None).when(got.isNull(), "other").otherwise(got["failure"])
    return judged.select("site_id", "pos", "url", F.when(~barred & ~left_out, got["status"]).alias("status"), failure.alias("failure"), "used_by")


def scope_lines(sites: DataFrame, o: Options) -> DataFrame:
    """(site_id, scope): what a run looked at and what it didn't, as labels and values in the order of a report."""
    yes = lambda flag: "yes" if flag else "no"
    line = lambda label, value: F.struct(F.lit(label).alias("label"), (value if isinstance(value, Column) else F.lit(str(value))).cast("string").alias("value"))
    s = F.col("delay_ms") / 1000
    governs = F.when(F.col("delay_ms") > o.delay_ms, T.said(F.regexp_replace(s.cast("string"), r"\.0$", ""), F.when(s == 1, " second").otherwise(" seconds"), " (from robots.txt", F.when(F.col("clamped"), ", which asks for more"), ")"))
    limit = lambda name: F.coalesce(F.col(f"limits.{name}"), F.lit(0))
    lines = F.array(
        line("Notice", F.lit("robots.txt was ignored." if o.ignore_robots else None)), line("Start URL", F.col("requested")), line("Audited origin", F.col("origin")), line("Origin note", F.when(F.col("origin") != origin(F.col("requested")), T.said("The start URL leads to ", F.col("origin"), "/"))),
        line("Pages crawled", T.said(limit("pages_crawled"), f" (limit {o.max_pages})")), line("Depth limit", o.max_depth), line("Left uncrawled", limit("uncrawled")), line("Skipped by robots.txt", F.size("blocked_by_robots")), line("Ignore robots.txt", yes(o.ignore_robots)), line("External links checked", yes(o.external)),
        line("Assets not measured", limit("assets_not_measured")), line("Crawl delay", governs if not o.ignore_robots else F.lit(None)), line("Groups of rules", ", ".join(o.groups)), line("Not seen", "; ".join(NOT_SEEN)),
    )
    return sites.select("site_id", F.filter(lines, lambda x: x["value"].isNotNull()).alias("scope"))


def run(starts: DataFrame, web: DataFrame, o: Options | None = None) -> Run:
    """Open, crawl, probe and audit sites (site_id, start_url)."""
    o = o or Options()
    got = web.where("method = 'GET'").select("url", "status", "headers", "failure", "html")
    files = kept(robots_files(got), "robots")
    rules = kept(robots.parsed(files.where("text is not null").select("site_id", "text")), "robots")
    open_ = kept(opened(starts, got, files, rules, o), "opened")
    sites = open_.where("problem is null").select("site_id", "requested", F.col("url").alias("landing"), "origin", "hops")
    own_rules = rules.withColumnRenamed("site_id", "origin").join(sites.select("site_id", "origin"), "origin").drop("origin")
    heeded = own_rules.where(F.lit(not o.ignore_robots))
    named = sitemaps.named(robots.sitemaps(own_rules), sites)
    guess = sites.join(named, "site_id", "left_anti").select("site_id", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit("/sitemap.xml").alias("path"))
    guesses = robots.decisions(guess, heeded, o.user_agent).drop("path")
    map_files, map_urls = (kept(t, "sitemaps") for t in sitemaps.loaded(named, got, sites, guesses))

    moved = F.col("origin") != origin(F.col("requested"))
    begin = sites.select("site_id", F.when(moved, F.col("landing")).otherwise(F.col("requested")).alias("start_url"), "origin")
    extract = lambda df: html.documents(html.parsed(df, *[c for c in df.columns if c not in ("html", "final_url")]), F.try_element_at("headers", F.lit("x-robots-tag")))
    pages, blocked, left = crawl.crawled(begin, got, heeded, map_urls, extract, o.user_agent, o.max_pages, o.max_depth, o.exclude)
    pages = pages.withColumn("doc", F.when(F.col("status").between(200, 299) & F.col("is_html"), F.col("doc")))
    led = sites.where(moved).select("site_id", F.lit(0.5).alias("ord"), F.col("requested").alias("url"), F.col("landing").alias("final_url"), "hops", F.lit(200).alias("status"), F.lit(0).alias("depth"), F.lit(False).alias("from_sitemap"), F.lit(False).alias("in_sitemap"), F.lit(True).alias("is_html"), F.col("origin").alias("site_origin"))
    pages = kept(pages.unionByName(led, allowMissingColumns=True), "pages")

    resources, barred = _assets(pages, web, sites, heeded, o)
    resources = kept(resources, "assets")
    external = _external(pages, web, sites, heeded, o) if o.external else None
    blocked = blocked.unionByName(barred).unionByName(guesses.where("not allowed").select("site_id", "url"))
    probed = probes.of_origins(pages, sites.select("site_id", "origin"), web, heeded, o.user_agent, o.exclude)
    maps = robots.sitemaps(own_rules).groupBy("site_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "url"))), lambda x: x["url"]).alias("sitemaps"))
    state = sites.select("site_id", F.col("origin").alias("_o")).join(files.select(F.col("site_id").alias("_o"), "status", F.col("text").isNotNull().alias("present")), "_o", "left").drop("_o")
    for more in (robots.disallow_all(own_rules), robots.crawl_delays(own_rules, o.user_agent), maps):
        state = state.join(more, "site_id", "left")
    counts = pages.groupBy("site_id").agg(F.count_if(~F.col("failure").eqNullSafe("blocked-by-robots") & (F.col("status").isNull() | F.coalesce("is_html", F.lit(False)))).cast("int").alias("pages_crawled"))
    unmeasured = resources.groupBy("site_id").agg(F.count_if(~F.coalesce("measured", F.lit(False))).cast("int").alias("assets_not_measured"))
    facts = sites.select("site_id", "requested", F.when(F.size("hops") > 0, F.col("landing")).otherwise(F.col("requested")).alias("start_url"), "origin")
    gathered = (
        state.select("site_id", "delay_ms", "clamped", F.struct("status", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("disallow_all", F.lit(False)).alias("disallow_all"), F.coalesce("sitemaps", F.array().cast("array<string>")).alias("sitemaps"), F.col("delay_ms").alias("crawl_delay_ms"), F.lit(o.ignore_robots).alias("ignored")).alias("robots")),
        map_files.groupBy("site_id").agg(F.bool_or("ok").alias("sitemap_found")),
        probed.select("site_id", F.struct("http_to_https", "sibling_redirects", "sibling_host", "soft404", "favicon").alias("probes")),
        blocked.groupBy("site_id").agg(F.array_sort(F.collect_set("url")).alias("blocked_by_robots")),
        counts, unmeasured, left.select("site_id", F.col("n").cast("int").alias("uncrawled")),
    )
    for more in gathered:
        facts = facts.join(more, "site_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    limits = F.struct(F.lit(o.max_pages).alias("max_pages"), F.lit(o.max_depth).alias("max_depth"), zero("pages_crawled"), zero("uncrawled"), zero("assets_not_measured"), F.lit(False).alias("delay_raised"))
    facts = kept(facts.withColumn("limits", limits).withColumn("external_checked", F.lit(o.external)).withColumn("blocked_by_robots", F.coalesce("blocked_by_robots", F.array().cast("array<string>"))).drop("pages_crawled", "uncrawled", "assets_not_measured"), "sites")
    done = audit(pages.drop("site_origin"), facts.drop("requested", "delay_ms", "clamped"), resources, map_files, map_urls, external, o.groups, graph.usage(pages))
    return Run(open_, replace(done, scope=scope_lines(facts, o)))
