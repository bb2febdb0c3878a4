"""Relations derived from pages: who links to whom, which resources and other sites are used, and rules that relate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import origin
from ..sources.tables import kept
from . import rules as R


#: As many pages are named with a link or resource: rules show five.
SHOWN = 6


def first_seen(rows: DataFrame, place: str) -> DataFrame:
    """Rows (site_id, place, ...) with pos: their number within the site by place, from 0. Places are distinct within a site.

    Rows are dealt out by ranges of site and place, numbered within each range, and moved on by what the ranges before hold: no
    site, however large, is numbered by one task.
    """
    ranged = rows.repartitionByRange("site_id", place).sortWithinPartitions("site_id", place).withColumn("_range", F.spark_partition_id())
    held = kept(ranged, "first-seen")
    before = Window.partitionBy("site_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("site_id", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("site_id", "_range").orderBy(place))
    return held.withColumn("_own", own).join(offsets, ["site_id", "_range"]).withColumn("pos", (F.col("_before") + F.col("_own") - 1).cast("int")).drop("_range", "_own", "_before")


def edges(pages: DataFrame) -> DataFrame:
    """(site_id, source, source_ord, pos, target): the links of each page, fragments and order included."""
    return pages.select("site_id", F.col("url").alias("source"), F.col("ord").alias("source_ord"), F.posexplode_outer("doc.links").alias("pos", "link")).where("link.url is not null").select("site_id", "source", "source_ord", "pos", F.col("link.url").alias("target"), F.col("link.internal").alias("internal"))


def _first_of(rows: DataFrame, by: list[str], place: str, value: str, name: str) -> DataFrame:
    """For each group its first SHOWN values by place, as an array, and n, how many there are. No group is gathered whole."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.select(*by, place, value, F.row_number().over(Window.partitionBy(*by).orderBy(place, value)).alias("_rank")).where(F.col("_rank") <= SHOWN)
    first = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", value))), lambda x: x[value]).alias(name))
    return n.join(first, by)


def with_inlinks(pages: DataFrame) -> DataFrame:
    """Pages with the URLs of the first SHOWN other pages that link to them, in page order, and n_inlinks, how many pages do."""
    links = edges(pages).where("source != target").groupBy("site_id", "target", "source").agg(F.min("source_ord").alias("ord"))
    gathered = _first_of(links, ["site_id", "target"], "ord", "source", "_inlinks").withColumnsRenamed({"target": "url", "n": "n_inlinks"})
    return pages.drop("inlinks", "n_inlinks").join(gathered, ["site_id", "url"], "left").withColumn("inlinks", F.coalesce("_inlinks", F.array().cast("array<string>"))).withColumn("n_inlinks", F.coalesce("n_inlinks", F.lit(0))).drop("_inlinks")


def _uses(pages: DataFrame) -> DataFrame:
    """(site_id, url, page, place, kind, site_origin): resources by page, each once, at its first place there."""
    kinds = F.concat(
        F.transform("doc.images", lambda i: F.struct(F.lit("image").alias("kind"), i["url"].alias("url"))),
        F.transform("doc.scripts", lambda s: F.struct(F.lit("script").alias("kind"), s["url"].alias("url"))),
        F.transform("doc.stylesheets", lambda s: F.struct(F.lit("stylesheet").alias("kind"), s["url"].alias("url"))),
    )
    used = pages.where("doc is not null").select("site_id", "ord", F.col("url").alias("page"), "site_origin", F.posexplode(kinds).alias("at", "a")).where("a.url is not null")
    place = F.struct("ord", "at")
    return used.groupBy("site_id", F.col("a.url").alias("url"), "page").agg(F.min(place).alias("place"), F.min_by("a.kind", place).alias("kind"), F.first("site_origin").alias("site_origin"))


def usage(pages: DataFrame) -> DataFrame:
    """(site_id, url, page): which page uses which resource."""
    return _uses(pages).select("site_id", "url", "page")


def assets(pages: DataFrame) -> DataFrame:
    """(site_id, pos, url, kind, third_party, used_by, n_pages): each resource once, in first-seen order, of the kind it is first used as, with the first SHOWN pages that use it."""
    each = _uses(pages)
    one = each.groupBy("site_id", "url").agg(F.min_by("kind", "place").alias("kind"), F.min("place").alias("place"), F.first("site_origin").alias("site_origin"))
    one = one.join(_first_of(each, ["site_id", "url"], "place", "page", "used_by"), ["site_id", "url"])
    return first_seen(one, "place").select("site_id", "pos", "url", "kind", (~F.coalesce(origin(F.col("url")) == F.col("site_origin"), F.lit(False))).alias("third_party"), "used_by", F.col("n").alias("n_pages"))


def external_links(pages: DataFrame) -> DataFrame:
    """(site_id, pos, url, used_by, n_pages): each linked URL of another origin once, in first-seen order, with the first SHOWN pages that link to it."""
    out = edges(pages).where("not internal")
    each = out.groupBy("site_id", F.col("target").alias("url"), "source").agg(F.min(F.struct("source_ord", "pos")).alias("place"))
    one = each.groupBy("site_id", "url").agg(F.min("place").alias("place")).join(_first_of(each, ["site_id", "url"], "place", "source", "used_by"), ["site_id", "url"])
    return first_seen(one, "place").select("site_id", "pos", "url", "used_by", F.col("n").alias("n_pages"))


def page_weights(pages: DataFrame, assets: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(site_id, url, total, not_measured) of each page: its document and the resources that it uses.

    `used` (site_id, url, page) says which these are; without it, used_by does, and has to name all pages.
    """
    if used is None:
        used = assets.select("site_id", F.explode("used_by").alias("url"), "bytes", "measured")
    else:
        used = used.join(assets.select("site_id", "url", "bytes", "measured"), ["site_id", "url"]).select("site_id", F.col("page").alias("url"), "bytes", "measured")
    known = F.col("measured") & F.col("bytes").isNotNull()
    sums = used.groupBy("site_id", "url").agg(F.sum(F.when(known, F.col("bytes"))).alias("assets"), F.count_if(~F.coalesce(known, F.lit(False))).alias("not_measured"))
    own = F.coalesce("transfer_bytes", "bytes", F.lit(0))
    return pages.where("is_page").select("site_id", "url", own.alias("own")).join(sums, ["site_id", "url"], "left").select("site_id", "url", (F.col("own") + F.coalesce("assets", F.lit(0))).alias("total"), F.coalesce("not_measured", F.lit(0)).alias("not_measured"))


def _variants(members: DataFrame) -> DataFrame:
    """(site_id, value, url) of members that name another one with their value as canonical."""
    named = members.select("site_id", "value", F.col("url").alias("own"), F.col("final_url").alias("own_final"), F.explode("canonicals").alias("target")).where("target != own and target != own_final")
    at = members.select("site_id", "value", F.col("url").alias("target"), F.col("url").alias("other")).unionByName(members.select("site_id", "value", F.col("final_url").alias("target"), F.col("url").alias("other")))
    return named.join(at, ["site_id", "value", "target"]).where("other != own").select("site_id", "value", F.col("own").alias("url")).distinct()


def duplicates(pages: DataFrame, value: str, variants: bool = True) -> DataFrame:
    """(site_id, url, value, others, n_others): indexable pages that share a value, without case and outer blanks.

    A page that names another page of its set as canonical is a variant of it, and not counted; without `variants` every page is.
    """
    key = F.lower(T.trimmed(F.col(value)))
    members = pages.where("indexable").select("site_id", "ord", "url", "final_url", key.alias("value"), "doc.canonicals").where("value is not null and value != ''")
    kept = members.join(_variants(members), ["site_id", "value", "url"], "left_anti") if variants else members
    sized = kept.groupBy("site_id", "value").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    # six suffice to name five others: no set is gathered whole
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("site_id", "value").orderBy("ord", "url"))).where("rank <= 6")
    first = ranked.groupBy("site_id", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("first"))
    return kept.join(sized, ["site_id", "value"]).join(first, ["site_id", "value"]).select("site_id", "url", "value", F.slice(F.filter("first", lambda u: u != F.col("url")), 1, 5).alias("others"), (F.col("n") - 1).alias("n_others"))


def finding(df: DataFrame, id: str, detail, evidence=None, url="url") -> DataFrame:
    r = R.get(id)
    return df.select("site_id", F.lit(id).alias("check_id"), F.lit(r.severity).alias("severity"), F.lit(r.group).alias("group"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"), detail.alias("detail"), (evidence if evidence is not None else F.lit(None).cast("array<string>")).alias("evidence"))


def start_pages(pages: DataFrame) -> DataFrame:
    """Each site's start page: the page that was requested by that URL, or else ended there."""
    rank = F.struct((F.col("url") != F.col("site_start")).alias("by_final"), "ord")
    return pages.where("is_page and is_start").groupBy("site_id").agg(F.min_by(F.struct("url", "headers"), rank).alias("start")).select("site_id", F.col("start.url").alias("url"), F.col("start.headers").alias("headers"))


def relations(pages: DataFrame, sites: DataFrame, assets: DataFrame, sitemap_urls: DataFrame, used: DataFrame | None = None) -> list[DataFrame]:
    """Findings of the rules that relate rows to each other."""
    out = []
    for id, value, what in (("SEO-TITLE-003", "doc.title", "title"), ("SEO-DESC-012", "doc.meta_description", "meta description")):
        out.append(finding(duplicates(pages, value), id, T.said(f"The {what} is also that of ", F.col("n_others"), " other indexable ", T.plural(F.col("n_others"), "page.", "pages.")), F.col("others")))
    named = pages.where("indexable").select("site_id", "url", "final_url", F.explode(F.array_distinct("doc.canonicals")).alias("canonical"))
    targets = pages.groupBy("site_id", F.col("url").alias("canonical")).agg(F.min_by(F.struct("url", "status", "failure", F.size("hops").alias("n_hops")), "ord").alias("t"))
    bad = named.join(targets, ["site_id", "canonical"]).where("t.url != url and not (t.failure <=> 'blocked-by-robots') and not (t.status <=> 429 or t.status <=> 503) and (t.n_hops > 0 or not (t.status <=> 200))")
    says = F.when(F.col("t.n_hops") > 0, "The canonical URL redirects.").when(F.col("t.status").isNull(), "The canonical URL could not be loaded.").otherwise(T.said("The canonical URL answers with status ", F.col("t.status"), "."))
    out.append(finding(bad, "SEO-CANON-032", says, F.array("canonical")))
    blocked = sites.select("site_id", F.explode("blocked_by_robots").alias("url"))
    out.append(finding(sitemap_urls.join(blocked, ["site_id", "url"], "left_semi"), "SEO-INDEX-042", F.lit("The sitemap lists the URL, and robots.txt disallows it.")))
    start = pages.where("is_start").where(F.arrays_overlap("doc.meta_robots", F.array(F.lit("noindex"), F.lit("none")))).groupBy("site_id").agg(F.min_by("url", "ord").alias("url"))
    out.append(finding(start, "SEO-INDEX-043", F.lit("The start page says noindex.")))
    reached = pages.where("size(inlinks) > 0").select("site_id", F.col("final_url").alias("_reached")).distinct()
    orphans = pages.where("is_page and coalesce(in_sitemap, false) and coalesce(size(inlinks), 0) <= 0 and not is_start").join(reached.withColumnRenamed("_reached", "url"), ["site_id", "url"], "left_anti")
    out.append(finding(orphans, "SEO-MAP-094", F.lit("The sitemap lists the page, but no page links to it.")))
    weights = page_weights(pages, assets, used)
    heavy = T.said("What was measured of the page has ", T.megabytes(F.col("total")), " MB; ", F.col("not_measured"), T.plural(F.col("not_measured"), " resource", " resources"), " could not be measured.")
    out.append(finding(weights.where("total > 2000000 and total <= 5000000"), "PERF-WEIGHT-040", heavy))
    out.append(finding(weights.where("total > 5000000"), "PERF-WEIGHT-041", heavy))
    starts, own = start_pages(pages), sites.select("site_id", "origin")
    lacking = pages.where("is_page").groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(~has()).alias(id) for id, (_, _, has) in R.HEADERS.items()])
    facts = starts.join(lacking, "site_id").join(own, "site_id")
    for id, (_, name, has) in R.HEADERS.items():
        fires = ~has() & (F.col("origin").startswith("https://") if id.endswith("050") else F.lit(True))
        others = F.col(id) - 1
        also = F.when(F.col("pages") > 1, T.said(" ", others, T.plural(others, " other page lacks it too.", " other pages lack it too.")))
        out.append(finding(facts.where(fires), id, T.said(f"The start page sends no {name} header.", also), url=None))
    return out
