"""Outcomes of rules, and what reports count: by group, by page, and what to fix first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules as R


def site_facts(pages: DataFrame, sites: DataFrame, assets: DataFrame, files: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """One row per site, with all that the applicability of a rule depends on, and the sites' own columns."""
    counted = pages.groupBy("site_id").agg(F.count_if("is_page").alias("n_pages"), F.count_if("requested").alias("n_requested"), F.bool_or(F.col("is_page") & F.col("is_start")).alias("has_start"))
    measured = assets.groupBy("site_id").agg(F.count_if(F.col("measured") & F.col("bytes").isNotNull()).alias("n_assets"))
    named = files.join(sites.select("site_id", F.coalesce("robots.sitemaps", F.array().cast("array<string>")).alias("named")), "site_id")
    unread = F.array_contains("named", F.col("url")) & ~F.coalesce("ok", F.lit(False))
    tried = named.groupBy("site_id").agg(
        F.count_if(~F.col("note").eqNullSafe(R.SKIPPED_NOTE)).alias("n_files_tried"),
        F.count_if(F.col("note").eqNullSafe(R.SKIPPED_NOTE)).alias("n_files_skipped"),
        F.count_if(F.col("status") == 200).alias("n_files_ok_status"),
        F.min_by(F.coalesce("note", F.concat(F.lit("status "), F.col("status").cast("string"))), F.when(unread, F.col("pos"))).alias("unread_note"),
    )
    urls = sitemap_urls.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_sitemap_urls"))
    out = sites
    for more in (counted, measured, tried, urls):
        out = out.join(more, "site_id", "left")
    zero = {c: 0 for c in ("n_pages", "n_requested", "n_assets", "n_files_tried", "n_files_skipped", "n_files_ok_status", "n_sitemap_urls")}
    return (
        out.fillna(zero | {"has_start": False})
        .withColumn("robots_ignored", F.col("robots.ignored"))
        .withColumn("uncrawled", F.col("limits.uncrawled"))
        .withColumn("is_http", F.col("origin").startswith("http://"))
        .withColumn("probe_http", F.col("probes.http_to_https"))
        .withColumn("probe_sibling", F.col("probes.sibling_redirects"))
        .withColumn("sibling_host", F.col("probes.sibling_host"))
        .withColumn("probe_soft404", F.col("probes.soft404"))
        .withColumn("probe_favicon", F.col("probes.favicon"))
    )


def outcomes(findings: DataFrame, facts: DataFrame, groups: tuple[str, ...] = R.GROUPS) -> DataFrame:
    """(site_id, check_id, group, severity, status, n): not-applicable, fail or pass of each rule for each site."""
    each = F.array(*[F.struct(F.lit(r.id).alias("check_id"), F.lit(r.group).alias("group"), F.lit(r.severity).alias("severity"), F.coalesce(F.expr(r.applies), F.lit(False)).alias("applies")) for r in R.registry(groups)])
    n = findings.groupBy("site_id", "check_id").agg(F.count(F.lit(1)).alias("n"))
    rows = facts.select("site_id", F.inline(each)).join(n, ["site_id", "check_id"], "left")
    status = F.when(~F.col("applies"), "not-applicable").when(F.col("n") > 0, "fail").otherwise("pass")
    return rows.select("site_id", "check_id", "group", "severity", status.alias("status"), F.when(F.col("applies"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n"))


def applicable(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings of rules that apply to their site."""
    each = F.array(*[F.struct(F.lit(r.id).alias("check_id"), F.coalesce(F.expr(r.applies), F.lit(False)).alias("applies")) for r in R.registry()])
    return findings.join(facts.select("site_id", F.inline(each)).where("applies").drop("applies"), ["site_id", "check_id"], "left_semi")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def by_group(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, group, error, warning, info): findings by their own severity; groups without any count 0."""
    dimension = sites.select("site_id", F.explode(F.array(*map(F.lit, R.GROUPS))).alias("group"))
    counts = findings.groupBy("site_id", "group").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITIES])
    return dimension.join(counts, ["site_id", "group"], "left").fillna(0, list(R.SEVERITIES))


def summary_rows(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """`by_group` with a row of totals per site, of group `Total`."""
    rolled = by_group(findings, sites).rollup("site_id", "group").agg(*[F.sum(s).alias(s) for s in R.SEVERITIES])
    return rolled.where("site_id is not null").withColumn("group", F.coalesce("group", F.lit("Total")))


def affected(findings: DataFrame) -> DataFrame:
    """(site_id, check_id, affected): different URLs, and the site itself where a finding names none."""
    return findings.groupBy("site_id", "check_id").agg((F.countDistinct("url") + F.max(F.col("url").isNull().cast("int"))).alias("affected"))


def fix_first(findings: DataFrame, outcome: DataFrame, most: int = 5) -> DataFrame:
    """(site_id, rank, check_id, severity, affected): failed errors before warnings, those that affect most first."""
    failed = outcome.where("status = 'fail' and severity != 'info'").select("site_id", "check_id", "severity")
    counted = failed.join(affected(findings.where("severity != 'info'")), ["site_id", "check_id"])
    order = Window.partitionBy("site_id").orderBy(severity_rank(F.col("severity")), F.desc("affected"), "check_id")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("site_id", "rank", "check_id", "severity", "affected")


def page_counts(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(site_id, url, ord, status, error, warning, info) of every page."""
    counts = findings.where("url is not null").groupBy("site_id", "url").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITIES])
    return pages.select("site_id", "url", "ord", "status").join(counts, ["site_id", "url"], "left").fillna(0, list(R.SEVERITIES))


def status_counts(outcome: DataFrame) -> DataFrame:
    return outcome.groupBy("site_id").agg(F.count_if(F.expr("status != 'not-applicable'")).alias("run"), F.count_if(F.expr("status = 'pass'")).alias("passed"), F.count_if(F.expr("status = 'fail'")).alias("failed"), F.count_if(F.expr("status = 'not-applicable'")).alias("not_applicable"))


def shown(findings: DataFrame, most: int = 10) -> DataFrame:
    """The first findings of each rule, in order of URL, and how many more there are."""
    by_rule = Window.partitionBy("site_id", "check_id").orderBy(F.col("url").isNotNull(), "url", "detail")
    # the count is a sum apart: a count over the window would gather all findings of a rule in one task
    counts = findings.groupBy("site_id", "check_id").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more"))
    return findings.withColumn("rank", F.row_number().over(by_rule)).where(F.col("rank") <= most).join(counts, ["site_id", "check_id"])


def exit_codes(findings: DataFrame, sites: DataFrame, fail_on: str = "error") -> DataFrame:
    """(site_id, exit_code): 1 where a finding is at least as severe as `fail_on`; `never` fails nothing."""
    limit = {"error": 0, "warning": 1, "info": 2, "never": -1}[fail_on]
    bad = findings.groupBy("site_id").agg(F.min(severity_rank(F.col("severity"))).alias("worst"))
    return sites.select("site_id").join(bad, "site_id", "left").select("site_id", F.when(F.col("worst") <= limit, 1).otherwise(0).alias("exit_code"))
