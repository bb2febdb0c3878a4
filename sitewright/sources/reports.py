"""Reports, one document per site, made by Spark and written by Spark: JSON, text, Markdown and HTML.

A site's report is a row, so many sites' reports are made and written in parallel, and none passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rollups
from ..operators import rules as R
from ..plans.audit import Audit

SCHEMA_VERSION = 1
#: What no audit of captured pages sees; a report whose scope says so itself doesn't say it twice.
NOT_SEEN = ("what scripts draw", "pages behind a login", "how fast the site is for its visitors", "contrast, keyboard use and screen readers")


def registry_table(spark) -> DataFrame:
    """The rules themselves: id, group, severity, title, heuristic."""
    rows = [(r.id, r.group, r.severity, r.title, r.heuristic) for r in R.registry()]
    return spark.createDataFrame(rows, "check_id string, group string, severity string, title string, heuristic string")


def results(a: Audit, shown: int | None = None) -> DataFrame:
    """One nested row per site: summary, fix_first, checks with their findings (the first `shown`, and how many more), pages."""
    spark = a.findings.sparkSession
    found = a.findings.withColumn("rank", F.lit(0)).withColumn("more", F.lit(0)) if shown is None else rollups.shown(a.findings, shown)
    listed = found.groupBy("site_id", "check_id").agg(F.array_sort(F.collect_list(F.struct("url", "severity", "detail", "evidence"))).alias("findings"), F.max("more").alias("more"))
    titles = F.broadcast(registry_table(spark).select("check_id", "title", "heuristic"))
    checks = a.outcomes.join(titles, "check_id").join(listed, ["site_id", "check_id"], "left")
    entry = F.struct("check_id", "group", "severity", "title", "heuristic", "status", F.coalesce("findings", F.array().cast("array<struct<url:string,severity:string,detail:string,evidence:array<string>>>")).alias("findings"), F.coalesce("more", F.lit(0)).alias("more"))
    by_site = checks.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("checks"))
    summary = a.summary.groupBy("site_id").agg(F.collect_list(F.struct("group", *R.SEVERITIES)).alias("summary"))
    first = a.fix_first.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("rank", "check_id", "severity", "affected"))).alias("fix_first"))
    pages = a.page_counts.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "status", *R.SEVERITIES))), lambda p: F.struct(p["url"].alias("url"), p["status"].alias("status"), *[p[s].alias(s) for s in R.SEVERITIES])).alias("pages"))
    counts = rollups.status_counts(a.outcomes)
    out = a.facts.select("site_id", "start_url", "origin")
    scope = [] if a.scope is None else [a.scope]
    for more in (*scope, summary, first, by_site, pages, counts):
        out = out.join(more, "site_id", "left")
    if not scope:
        out = out.withColumn("scope", F.lit(None).cast("array<struct<label:string,value:string>>"))
    order = F.array(*map(F.lit, [*R.GROUPS, "Total"]))
    # the rows of a summary in the order of the groups
    return out.withColumn("summary", F.filter(F.transform(order, lambda g: F.get(F.filter("summary", lambda s: s["group"] == g), F.lit(0))), lambda s: s.isNotNull())).withColumn("fix_first", F.coalesce("fix_first", F.array().cast("array<struct<rank:int,check_id:string,severity:string,affected:bigint>>")))


def escape_invisible(json: Column) -> Column:
    """Invisible and direction-changing characters of a JSON text as escapes."""
    for point in (*range(0x7F, 0xA0), 0xAD, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x2028, 0x202F), *range(0x2060, 0x2070), 0xFEFF):
        json = F.replace(json, F.lit(chr(point)), F.lit(f"\\u{point:04x}"))
    # tag characters lie beyond 16 bits: each is a pair of escapes, of which the first is always the same
    tags = [F.lit(chr(point)) for point in range(0xE0000, 0xE0080)]
    escaped = F.array(*[F.struct(t.alias("c"), F.lit(f"\\udb40\\udc{point:02x}").alias("e")) for point, t in enumerate(tags)])
    return F.when(json.rlike("[\U000E0000-\U000E007F]"), F.aggregate(escaped, json, lambda text, x: F.replace(text, x["c"], x["e"]))).otherwise(json)


def as_json(a: Audit) -> DataFrame:
    """(site_id, report): complete and untruncated."""
    rows = results(a)
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in rows.columns])
    return rows.select("site_id", F.concat(escape_invisible(F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"})), F.lit("\n")).alias("report"))


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "")


def _scope(line) -> Column:
    """The lines of what a run looked at; nothing where it isn't known."""
    return F.coalesce(_lines(F.col("scope"), line), F.lit(""))


def _failed(c: str = "checks") -> Column:
    return F.filter(c, lambda k: k["status"] == "fail")


def as_text(a: Audit, shown: int = 10) -> DataFrame:
    say, clean, url = T.said, T.clean, T.clean_url
    one = lambda f: say("    - ", F.when(f["url"].isNotNull(), say(url(f["url"]), ": ")), clean(f["detail"]), "\n", _lines(F.coalesce(f["evidence"], F.array().cast("array<string>")), lambda e: say("        ", url(e), "\n")))
    check = lambda k: say("  ", k["check_id"], " [", k["severity"], "] ", k["title"], "\n", _lines(k["findings"], one), F.when(k["more"] > 0, say("    ... and ", k["more"], " more\n")))
    row = lambda s: say("  ", F.rpad(s["group"], 15, " "), F.lpad(s["error"].cast("string"), 7, " "), F.lpad(s["warning"].cast("string"), 9, " "), F.lpad(s["info"].cast("string"), 6, " "), "\n")
    report = say(
        "Audit of ", url(F.col("start_url")), "\n", _scope(lambda s: say("  ", s["label"], ": ", clean(s["value"]), "\n")), "\nSummary\n  ", F.rpad(F.lit("group"), 15, " "), "  error  warning  info\n", _lines(F.col("summary"), row),
        "\nFix first\n", _lines(F.col("fix_first"), lambda f: say("  ", f["rank"], ". ", f["check_id"], " (", f["severity"], ", ", f["affected"], " affected)\n")),
        "\nFindings\n", _lines(_failed(), check), "\nChecks: ", F.col("failed"), " failed, ", F.col("passed"), " passed, ", F.col("not_applicable"), " not applicable.\n", F.when(F.exists(F.coalesce("scope", F.array().cast("array<struct<label:string,value:string>>")), lambda s: s["label"] == "Not seen"), "").otherwise("Not seen: " + "; ".join(NOT_SEEN) + ".\n"),
    )
    return results(a, shown).select("site_id", report.alias("report"))


def as_markdown(a: Audit, shown: int = 10) -> DataFrame:
    say, md = T.said, lambda c: T.escape_markdown_inline(T.clean(c))
    link = lambda c: T.escape_markdown_inline(T.clean_url(c))
    one = lambda f: say("- ", F.when(f["url"].isNotNull(), say(link(f["url"]), ": ")), md(f["detail"]), "\n", _lines(F.coalesce(f["evidence"], F.array().cast("array<string>")), lambda e: say("  - ", link(e), "\n")))
    check = lambda k: say("### ", k["check_id"], " ", md(k["title"]), "\n\n", "Severity: ", k["severity"], "\n\n", _lines(k["findings"], one), F.when(k["more"] > 0, say("- ... and ", k["more"], " more\n")), "\n")
    report = say(
        "# Audit of ", link(F.col("start_url")), "\n\n", _scope(lambda s: say("- ", s["label"], ": ", md(s["value"]), "\n")), "\n| Group | Error | Warning | Info |\n| --- | --- | --- | --- |\n", _lines(F.col("summary"), lambda s: say("| ", s["group"], " | ", s["error"], " | ", s["warning"], " | ", s["info"], " |\n")),
        "\n## Fix first\n\n", _lines(F.col("fix_first"), lambda f: say(f["rank"], ". ", f["check_id"], " (", f["severity"], ", ", f["affected"], " affected)\n")), "\n## Findings\n\n", _lines(_failed(), check),
    )
    return results(a, shown).select("site_id", report.alias("report"))


def as_html(a: Audit, shown: int = 50) -> DataFrame:
    say, h = T.said, lambda c: T.escape_html(T.clean(c))
    u = lambda c: T.escape_html(T.clean_url(c))
    link = lambda c: F.when(c.rlike("^https?://"), say('<a rel="noreferrer" href="', T.escape_html(c), '">', u(c), "</a>")).otherwise(u(c))
    one = lambda f: say("<li>", F.when(f["url"].isNotNull(), say(link(f["url"]), ": ")), h(f["detail"]), "</li>")
    check = lambda k: say('<section class="', k["severity"], '"><h3>', k["check_id"], " ", h(k["title"]), "</h3><ul>", _lines(k["findings"], one), "</ul>", F.when(k["more"] > 0, say("<p>and ", k["more"], " more</p>")), "</section>")
    cells = lambda s, *names: say(*[x for n in names for x in ("<td>", s[n].cast("string"), "</td>")])
    report = say(
        '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'"><title>Audit</title>',
        "<style>body{font:16px/1.5 sans-serif;margin:2rem auto;max-width:60rem;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem}.error h3{color:#a00}.warning h3{color:#850}</style></head><body><h1>Audit of ",
        u(F.col("start_url")), "</h1><dl>", _scope(lambda s: say("<dt>", s["label"], "</dt><dd>", h(s["value"]), "</dd>")), "</dl><table><tr><th>Group</th><th>Error</th><th>Warning</th><th>Info</th></tr>", _lines(F.col("summary"), lambda s: say("<tr>", cells(s, "group", *R.SEVERITIES), "</tr>")),
        "</table><h2>Fix first</h2><ol>", _lines(F.col("fix_first"), lambda f: say("<li>", f["check_id"], " (", f["affected"], " affected)</li>")), "</ol><h2>Findings</h2>", _lines(_failed(), check),
        "<h2>Passed</h2><ul>", _lines(F.filter("checks", lambda k: k["status"] == "pass"), lambda k: say("<li>", k["check_id"], " ", h(k["title"]), "</li>")), "</ul><h2>Pages</h2><table><tr><th>URL</th><th>Status</th><th>Error</th><th>Warning</th><th>Info</th></tr>",
        _lines(F.col("pages"), lambda p: say("<tr><td>", u(p["url"]), "</td>", cells(p, "status", *R.SEVERITIES), "</tr>")), "</table></body></html>\n",
    )
    return results(a, shown).select("site_id", report.alias("report"))


def write(reports: DataFrame, path: str) -> None:
    """Reports as text files below `path`, in a folder for each site."""
    reports.select(F.regexp_replace("site_id", r"[^A-Za-z0-9.-]", "_").alias("site"), "report").write.mode("overwrite").option("lineSep", "\n").partitionBy("site").text(path)
