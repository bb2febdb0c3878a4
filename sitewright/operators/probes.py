"""Probes: what asking for a resource, for other forms of a site's address or for a page that can't exist gives, over captured answers.

A probe is a walk: its rows hold the URL and the method that come next, and each step joins the rows that still move with the
answers. What is decided leaves the walk, what moves is written before the next step. Outcomes about a site are true, false, or
null where nothing can be said: a failure, a refusal or a detour says nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import excluded, hostname, origin, path_with_query, same_origin, same_site, sibling_host
from ..sources.tables import kept
from ..sources.web import content_length
from . import robots
from .crawl import MAX_HOPS, REDIRECTS, redirected, resolving

#: Scripts and stylesheets beyond this size that HEAD says nothing of the encoding of are asked for once more.
ENCODING_CHECK_BYTES = 1024
MAX_VARIANT_REQUESTS = 3
MISSING_PATH = "/no-such-page-4f1c"


def answers(web: DataFrame) -> DataFrame:
    """What probes read of answers (url, method, status, headers, failure, and bytes or body): everything but the bodies."""
    size = F.col("bytes") if "bytes" in web.columns else F.octet_length("body")
    header = lambda name: F.try_element_at("headers", F.lit(name))
    facts = F.struct(
        F.col("status").cast("int").alias("status"), F.col("failure").alias("failure"), header("location").alias("location"), content_length(F.col("headers")).alias("length"), size.cast("bigint").alias("body"),
        header("content-type").alias("content_type"), header("content-encoding").alias("content_encoding"), header("cache-control").alias("cache_control"), header("expires").alias("expires"),
    )
    return web.select(F.col("url").alias("_u"), F.col("method").alias("_m"), facts.alias("_a"))


def throttled(status: Column) -> Column:
    return F.coalesce(status.isin(429, 503), F.lit(False))


def authority(url: Column) -> Column:
    """Host and port."""
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def _moves(status: Column, location: Column) -> Column:
    return F.coalesce(status.isin(*REDIRECTS) & location.isNotNull(), F.lit(False))


def walked(rows: DataFrame, web: DataFrame, same_host: Column | None = None, check_encoding: Column | None = None, verdict: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows (url, ...) with status, failure, bytes, content_type, content_encoding, cache_control, expires, final_url, hops, requests.

    HEAD comes first; GET where HEAD is refused (405, 501), tells no length, or was not captured, at any hop, and from there on.
    A third request learns the encoding of what HEAD tells the length of (`check_encoding`). Redirects are followed, MAX_HOPS at
    most, where `same_host` is set never to another host. `bytes` is null where nothing was measured: a failure or a status of
    400 or more. `verdict` adds `failure` to rows with `_to`: where it isn't null, that hop isn't requested.
    """
    no, text = F.lit(False), F.lit(None).cast("string")
    names = rows.columns
    at = rows.withColumns({"_now": F.col("url"), "_method": F.lit("HEAD"), "_learns": no, "_trail": F.array("url"), "_requests": F.lit(0), "_same": same_host if same_host is not None else no, "_check": check_encoding if check_encoding is not None else no, "_known": F.lit(None).cast("struct<status:int,length:bigint,content_type:string,content_encoding:string,cache_control:string,expires:string>")})
    state = at.columns
    asked_of, done = answers(web), []
    headers = ("content_type", "content_encoding", "cache_control", "expires")

    def settled(ended: DataFrame, status: Column, failure: Column, size: Column, of: Column | None) -> None:
        told = [(of[h] if of is not None else text).alias(h) for h in headers]
        done.append(ended.select(*names, status.cast("int").alias("status"), failure.alias("failure"), size.cast("bigint").alias("bytes"), *told, F.col("_now").alias("final_url"), (F.size("_trail") - 1).alias("hops"), F.col("_requests").alias("requests")))

    while True:
        got = at.join(asked_of, (F.col("_now") == F.col("_u")) & (F.col("_method") == F.col("_m")), "left").withColumn("_requests", F.col("_requests") + 1)
        a, head = F.col("_a"), F.col("_method") == "HEAD"
        nothing = F.lit(None).cast("bigint")
        failed = a.isNull() | a["status"].isNull()
        moves = ~failed & _moves(a["status"], a["location"])
        # the third request: what it gives counts where it is a success, else what HEAD gave
        learned = got.where("_learns")
        success = F.coalesce(a["status"].between(200, 299), no)
        use = F.when(success, F.struct(a["status"].alias("status"), F.coalesce(a["length"], F.col("_known.length")).alias("length"), *[a[h].alias(h) for h in headers])).otherwise(F.col("_known"))
        learned = learned.withColumn("_known", use)
        settled(learned, F.col("_known.status"), text, F.col("_known.length"), F.col("_known"))
        got = got.where("not _learns")
        # a capture without a HEAD answer is asked for its GET answer
        again = head & (a.isNull() | (~moves & (F.coalesce(a["status"].isin(405, 501), no) | ((a["status"] < 400) & a["length"].isNull()))))
        again = F.coalesce(again, no)
        learns = F.coalesce(head & ~moves & ~again & ~failed & (a["status"] < 400) & F.col("_check") & a["content_encoding"].isNull() & (a["length"] > ENCODING_CHECK_BYTES), no)
        stays = F.coalesce(failed & ~again, no)
        settled(got.where(stays), F.lit(None), F.coalesce(a["failure"], F.lit("other")), nothing, None)
        size = F.when(a["status"] < 400, F.when(head, a["length"]).otherwise(a["body"]))
        settled(got.where(~failed & ~moves & ~again & ~learns), a["status"], text, size, a)
        known = F.struct(a["status"].alias("status"), a["length"].alias("length"), *[a[h].alias(h) for h in headers])
        onward = [got.where(again).withColumn("_method", F.lit("GET")).select(*state), got.where(learns).withColumns({"_method": F.lit("GET"), "_learns": F.lit(True), "_known": known}).select(*state)]
        turned = got.where(moves).withColumns({"_to": a["location"], "final_url": F.col("_now")}).select(*state, "_to", "final_url")
        turned = kept(turned.mapInArrow(resolving, turned.schema), "probe")
        if not turned.isEmpty():
            stop = F.when(F.size("_trail") > MAX_HOPS, "too-many-redirects").when(F.col("_to").isNull(), "other").when(F.col("_same") & (authority(F.col("_to")) != authority(F.col("_now"))), "other").when(F.array_contains("_trail", F.col("_to")), "redirect-loop")
            turned = turned.withColumn("_stop", stop)
            settled(turned.where("_stop is not null"), F.lit(None), F.col("_stop"), nothing, None)
            led = turned.where("_stop is null")
            if verdict:
                judged = kept(verdict(led), "probe")
                settled(judged.where("failure is not null"), F.lit(None), F.col("failure"), nothing, None)
                led = judged.where("failure is null")
            onward.append(led.withColumns({"_trail": F.array_append("_trail", F.col("_to")), "_now": F.col("_to")}).select(*state))
        at = kept(reduce(DataFrame.unionByName, onward), "probe")
        if at.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _guard(rules: DataFrame, sites: DataFrame, token: str, exclude: tuple[str, ...], stay: bool) -> Callable[[DataFrame], DataFrame]:
    """Why a hop isn't requested: another origin (`stay`), an excluded path, or robots.txt, where it is on the audited host."""
    own = sites.select("site_id", F.col("origin").alias("_origin"))

    def verdict(rows: DataFrame) -> DataFrame:
        placed = rows.join(own, "site_id").withColumn("path", path_with_query(F.col("_to")))
        decided = robots.decisions(placed, rules, token)
        audited = F.coalesce(hostname(F.col("_to")) == hostname(F.col("_origin")), F.lit(False))
        leaves = ~same_origin(F.col("_to"), F.col("_origin")) if stay else F.lit(False)
        why = F.when(leaves, "other").when(audited & excluded(F.col("_to"), list(exclude)), "other").when(audited & ~F.col("allowed"), "blocked-by-robots")
        return decided.withColumn("failure", why).drop("path", "allowed", "_origin")

    return verdict


def measured(assets: DataFrame, web: DataFrame, sites: DataFrame | None = None, rules: DataFrame | None = None, token: str = "sitewright", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Assets (site_id, pos, url, kind, third_party, used_by) with status, bytes, content_type, content_encoding, cache_control, measured.

    Those of the site itself never leave its origin, others never their host. What is throttled tells nothing.
    """
    verdict = None
    if sites is not None and rules is not None:
        own, other = _guard(rules, sites, token, exclude, True), _guard(rules, sites, token, exclude, False)
        verdict = lambda rows: own(rows.where("not third_party")).unionByName(other(rows.where("third_party")))
    got = walked(assets, web, F.col("third_party"), F.col("kind").isin("script", "stylesheet"), verdict)
    told = ~throttled(F.col("status"))
    known = told & F.col("bytes").isNotNull()
    cache = F.coalesce(F.nullif(F.trim("cache_control"), F.lit("")), F.when(F.col("expires").isNotNull(), "expires"))
    return got.select(
        *assets.columns, F.when(told, F.col("status")).alias("status"), F.when(known, F.col("bytes")).alias("bytes"), F.when(known, F.col("content_type")).alias("content_type"), F.when(known, F.col("content_encoding")).alias("content_encoding"),
        F.when(known, cache).alias("cache_control"), F.coalesce(known, F.lit(False)).alias("measured"),
    )


def _single(rows: DataFrame, web: DataFrame) -> DataFrame:
    """rows (url, ...) with the status and the resolved location of one GET, no redirect followed; a location that can't be resolved is null."""
    got = rows.join(answers(web).where("_m = 'GET'"), F.col("url") == F.col("_u"), "left").select(*rows.columns, F.col("_a.status").alias("status"), F.col("_a.location").alias("_to"), F.col("url").alias("final_url"))
    return got.mapInArrow(resolving, got.schema).drop("final_url")


def http_variant(sites: DataFrame, web: DataFrame, rules: DataFrame, token: str = "sitewright") -> DataFrame:
    """(site_id, http_to_https): whether plain HTTP leads to HTTPS, by MAX_VARIANT_REQUESTS requests at most that stay on the site.

    True where a redirect points at https on the site, false where a success comes over http, null else: a site on a port, a
    failure, another status, a redirect off the site, a longer chain, or a URL that robots.txt disallows.
    """
    port = F.regexp_extract("origin", r":(\d+)$", 1)
    at = sites.where(F.col("origin").startswith("https://") & (port == "")).select("site_id", "origin", F.concat(F.lit("http://"), hostname(F.col("origin")), F.lit("/")).alias("url"))
    known = []
    for _ in range(MAX_VARIANT_REQUESTS):
        decided = robots.decisions(at.withColumn("path", path_with_query(F.col("url"))), rules, token)
        may = decided.where(F.col("allowed") | (hostname(F.col("url")) != hostname(F.col("origin")))).select("site_id", "origin", "url")
        got = kept(_single(may, web), "probe")
        turns = F.col("status").between(300, 399) & F.col("_to").isNotNull() & same_site(F.col("_to"), F.col("origin"))
        outcome = F.when(F.col("status").between(200, 299), False).when(turns & F.col("_to").startswith("https:"), True)
        known.append(got.select("site_id", outcome.alias("http_to_https")).where("http_to_https is not null"))
        at = got.where(turns & ~F.col("_to").startswith("https:")).select("site_id", "origin", F.col("_to").alias("url"))
        if at.isEmpty():
            break
    return sites.select("site_id").join(reduce(DataFrame.unionByName, known), "site_id", "left")


def sibling(sites: DataFrame, web: DataFrame) -> DataFrame:
    """(site_id, sibling_host, sibling_redirects): whether www.x leads to x, or the other way round; false where it answers itself with 200."""
    name = sibling_host(hostname(F.col("origin")))
    port = F.regexp_extract("origin", r"(:\d+)$", 1)
    asked = sites.select("site_id", "origin", name.alias("sibling_host"), F.concat(F.regexp_extract("origin", "^(https?://)", 1), name, port, F.lit("/")).alias("url"))
    got = _single(asked, web)
    leads = F.col("status").between(300, 399) & (authority(F.col("_to")) == authority(F.col("origin")))
    return got.select("site_id", "sibling_host", F.when(F.col("status") == 200, False).when(leads, True).alias("sibling_redirects"))


def soft_missing(sites: DataFrame, web: DataFrame, rules: DataFrame, token: str = "sitewright", path: str = MISSING_PATH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, soft404): whether a path that can't exist answers with 200 at last; redirects are followed on the site's origin."""
    asked = sites.select("site_id", F.col("origin").alias("_origin"), F.concat("origin", F.lit(path)).alias("url"))

    def verdict(rows: DataFrame) -> DataFrame:
        decided = robots.decisions(rows.withColumn("path", path_with_query(F.col("_to"))), rules, token)
        why = F.when(~same_origin(F.col("_to"), F.col("_origin")), "origin").when(excluded(F.col("_to"), list(exclude)), "excluded").when(~F.col("allowed"), "robots")
        return decided.withColumn("reason", why).drop("path", "allowed")

    first = robots.decisions(asked.withColumn("path", F.lit(path)), rules, token).where("allowed").drop("path", "allowed")
    first = first.where(~excluded(F.col("url"), list(exclude)))
    pages = web.where("method = 'GET'").select("url", "status", "headers", "failure", F.lit(None).cast("string").alias("html"))
    got = redirected(first, pages, verdict)
    told = F.col("reason").isNull() & F.col("status").isNotNull() & ~throttled(F.col("status"))
    return sites.select("site_id").join(got.select("site_id", F.when(told, F.col("status") == 200).alias("soft404")), "site_id", "left")


def favicon(pages: DataFrame, sites: DataFrame, web: DataFrame, rules: DataFrame, token: str = "sitewright", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, favicon): a page names an icon, or /favicon.ico answers with 200; null where it may not be asked for, or tells nothing."""
    named = pages.groupBy("site_id").agg(F.bool_or("doc.icon_link").alias("named"))
    asked = sites.join(named.where("named"), "site_id", "left_anti").select("site_id", F.concat("origin", F.lit("/favicon.ico")).alias("url"))
    may = robots.decisions(asked.withColumn("path", F.lit("/favicon.ico")), rules, token).where("allowed").select("site_id", "url").where(~excluded(F.col("url"), list(exclude)))
    got = walked(may, web, verdict=_guard(rules, sites, token, exclude, True))
    there = got.select("site_id", F.when(F.col("status").isNotNull() & ~throttled(F.col("status")), F.col("status") == 200).alias("there"))
    return sites.select("site_id").join(named, "site_id", "left").join(there, "site_id", "left").select("site_id", F.when(F.col("named"), True).otherwise(F.col("there")).alias("favicon"))


def of_origins(pages: DataFrame, sites: DataFrame, web: DataFrame, rules: DataFrame, token: str = "sitewright", exclude: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, http_to_https, sibling_redirects, sibling_host, soft404, favicon) of each site (site_id, origin)."""
    return http_variant(sites, web, rules, token).join(sibling(sites, web), "site_id").join(soft_missing(sites, web, rules, token, exclude=exclude), "site_id").join(favicon(pages, sites, web, rules, token, exclude), "site_id")
