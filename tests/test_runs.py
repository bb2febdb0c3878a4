"""Runs from start URLs alone: where sites lead, why some can't be audited, and what a run measures and says of itself."""

import pytest
from pyspark.sql import functions as F

from sitewright import __main__ as cli
from sitewright.operators import robots
from sitewright.plans import runs
from sitewright.plans.audit import Options
from sitewright.sources import reports, sitemaps

WEB = "url string, method string, status int, headers map<string,string>, failure string, html string, bytes long"
PAGE = "<html lang=en><head><title>t</title><link rel=stylesheet href=/s.css></head><body><h1>x</h1><img src=/i.png alt=x><img src=/no/j.png alt=x><img src=https://cdn.example/k.png alt=x>"


def answer(url, body="", status=200, kind="text/html", method="GET", failure=None, **headers):
    return (url, method, status, {"content-type": kind} | headers, failure, body, len(body) if status else None)


def hop(url, to):
    return answer(url, "", 301, location=to)


def text(url, body="", status=200):
    return answer(url, body, status, "text/plain")


STARTS = {
    "plain": "https://a.example", "moved": "http://b.example/", "barred": "https://c.example/no/1", "broken": "https://d.example/", "unread": "https://e.example/", "image": "https://f.example/", "gone": "https://g.example/x",
    "far": "https://h.example/", "twice": "https://i.example/", "loop": "https://j.example/", "excluded": "https://k.example/", "into": "https://l.example/", "none": "mailto:x", "dead": "https://m.example/",
}
ANSWERS = [
    text("https://a.example/robots.txt", "User-agent: *\nDisallow: /no\nCrawl-delay: 2\nSitemap: /maps/all.xml\nSitemap: https://other.example/m.xml\nSitemap: /x.xml.gz\nSitemap: /away.xml\nSitemap: /none.xml"),
    answer("https://a.example/", PAGE + '<a href="/p">p</a><a href="/no/1">n</a><a href="https://out.example/">o</a><a href="http://a.example/no/2">h</a>'), answer("https://a.example/p", PAGE),
    hop("https://a.example/maps/all.xml", "real.xml"), hop("https://a.example/away.xml", "https://other.example/m.xml"), answer("https://a.example/maps/real.xml", "<urlset><url><loc>https://a.example/p</loc></url><url><loc>https://a.example/q</loc></url></urlset>", kind="application/xml"), answer("https://a.example/q", PAGE),
    answer("https://a.example/s.css", "x" * 100, kind="text/css"), answer("https://a.example/i.png", "", kind="image/png", method="HEAD", **{"content-length": "1234"}), answer("https://out.example/", "", 404, method="HEAD"),
    text("http://b.example/robots.txt", "", 404), hop("http://b.example/", "https://b.example/"), text("https://b.example/robots.txt", "", 404), hop("https://b.example/", "https://www.b.example/home"), text("https://www.b.example/robots.txt", ""), answer("https://www.b.example/home", PAGE), answer("https://www.b.example/sitemap.xml", "<html>no"),
    text("https://c.example/robots.txt", "User-agent: *\nDisallow: /no"), answer("https://c.example/no/1", PAGE),
    text("https://d.example/robots.txt", "", 503), answer("https://d.example/", PAGE), answer("https://e.example/", PAGE),
    text("https://f.example/robots.txt"), answer("https://f.example/", "", kind="image/png"), text("https://g.example/robots.txt"), answer("https://g.example/x", "", 410),
    text("https://h.example/robots.txt"), hop("https://h.example/", "https://far.example/"), text("https://far.example/robots.txt"), answer("https://far.example/", PAGE),
    text("https://i.example/robots.txt"), hop("https://i.example/", "https://far.example/on"), hop("https://far.example/on", "https://third.example/"),
    text("https://j.example/robots.txt"), hop("https://j.example/", "/a"), hop("https://j.example/a", "/"),
    text("https://k.example/robots.txt"), hop("https://k.example/", "/ex/1"), answer("https://k.example/ex/1", PAGE),
    text("https://l.example/robots.txt", "User-agent: *\nDisallow: /no"), hop("https://l.example/", "/no/1"), answer("https://l.example/no/1", PAGE),
    text("https://m.example/robots.txt"), answer("https://m.example/", None, None, failure="timeout"),
]


@pytest.fixture(scope="module")
def run(spark):
    starts = spark.createDataFrame(list(STARTS.items()), "site_id string, start_url string")
    return runs.run(starts, spark.createDataFrame(ANSWERS, WEB), Options(max_pages=10, exclude=("/ex/*",), external=True, groups=("seo", "health")))


def test_where_sites_lead(run):
    got = {r.site_id: r for r in run.opened.collect()}
    assert len(got) == len(STARTS)
    assert {k: (r.origin, len(r.hops)) for k, r in got.items() if r.problem is None} == {"plain": ("https://a.example", 0), "moved": ("https://www.b.example", 2), "far": ("https://far.example", 1)}
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        "barred": "robots.txt disallows https://c.example/no/1.", "into": "robots.txt disallows https://l.example/no/1.", "broken": "robots.txt of https://d.example can't be read (status 503).", "unread": "robots.txt of https://e.example can't be read (other).",
        "image": "The start URL is no HTML page (image/png).", "gone": "The start URL answers with status 410.", "twice": "The start URL redirects over several hosts; it isn't followed to https://third.example/.", "loop": "The start URL can't be reached (redirect-loop).",
        "excluded": "The start URL redirects to https://k.example/ex/1, which is excluded.", "none": "The start URL is no http or https URL.", "dead": "The start URL can't be reached (timeout).",
    }


def test_pages_and_findings(run):
    pages = {(r.site_id, r.url): r for r in run.audit.pages.collect()}
    assert {u for s, u in pages if s == "plain"} == {f"https://a.example/{p}" for p in ("", "p", "q")}
    assert {u: len(r.hops) for (s, u), r in pages.items() if s == "moved"} == {"http://b.example/": 2, "https://www.b.example/home": 0}
    assert pages["moved", "https://www.b.example/home"].is_start and pages["moved", "https://www.b.example/home"].is_page
    found = {(r.site_id, r.check_id, r.url) for r in run.audit.findings.collect()}
    assert ("plain", "HEALTH-EXT-060", "https://out.example/") in found or any(f[:2] == ("plain", "HEALTH-EXT-060") for f in found)
    assert any(f[:2] == ("moved", "SEO-MAP-090") for f in found) and not any(f[:2] == ("plain", "SEO-MAP-090") for f in found)
    assert ("plain", "SEO-MAP-094", "https://a.example/q") in found


def test_sitemap_files(spark):
    web = spark.createDataFrame(ANSWERS, WEB)
    sites = spark.createDataFrame([("plain", "https://a.example"), ("guessed", "https://www.b.example"), ("barred", "https://c.example")], "site_id string, origin string")
    rules = robots.parsed(spark.createDataFrame([("plain", ANSWERS[0][5])], "site_id string, text string"))
    guesses = spark.createDataFrame([("guessed", "https://www.b.example/sitemap.xml", True), ("barred", "https://c.example/sitemap.xml", False)], "site_id string, url string, allowed boolean")
    files, urls = sitemaps.loaded(sitemaps.named(robots.sitemaps(rules), sites), web, sites, guesses)
    assert [tuple(r) for r in files.orderBy("site_id", "pos").collect()] == [
        ("barred", 0, "https://c.example/sitemap.xml", None, False, "disallowed by robots.txt"), ("plain", 0, "https://a.example/maps/all.xml", 200, True, None), ("plain", 1, "https://other.example/m.xml", None, False, "on another site, not read"),
        ("plain", 2, "https://a.example/x.xml.gz", None, False, "gzip, not read"), ("plain", 3, "https://a.example/away.xml", 301, False, "redirects to another site, not read"), ("plain", 4, "https://a.example/none.xml", None, False, "not fetched"),
    ]
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://a.example/p", "https://a.example/q"]


def test_scope(run):
    got = {r.site_id: {s["label"]: s["value"] for s in r.scope} for r in run.audit.scope.collect()}
    assert set(got) == {"plain", "moved", "far"}
    plain = got["plain"]
    assert (plain["Pages crawled"], plain["Left uncrawled"], plain["Crawl delay"], plain["External links checked"]) == ("3 (limit 10)", "0", "2 seconds (from robots.txt)", "yes")
    # /no/1, /no/j.png; the plain-http link is asked for by no crawl
    assert plain["Skipped by robots.txt"] == "2" and "Origin note" not in plain and "Notice" not in plain
    assert got["moved"]["Origin note"] == "The start URL leads to https://www.b.example/" and got["moved"]["Start URL"] == "http://b.example/"
    for made in (reports.as_text(run.audit), reports.as_markdown(run.audit), reports.as_html(run.audit), reports.as_json(run.audit)):
        assert "Pages crawled" in made.where("site_id = 'plain'").first().report


def test_robots_files_are_cut_at_a_line(spark):
    rows = spark.createDataFrame([("Disallow: /a\nDisallow: /private",), ("short",), (None,)], "t string")
    assert [r[0] for r in rows.select(robots.readable(F.col("t"), 23)).collect()] == ["Disallow: /a\n", "short", None]


def test_a_run_of_no_sites(spark):
    none = spark.createDataFrame([], "site_id string, start_url string")
    got = runs.run(none, spark.createDataFrame([], WEB), Options(groups=("health",)))
    assert got.opened.count() == 0 and got.audit.findings.count() == 0


def test_the_crawl_command(spark, tmp_path):
    spark.createDataFrame(ANSWERS, WEB).write.parquet(str(tmp_path / "web"))
    for name, sites in (("one", ["plain"]), ("two", ["plain", "gone"])):
        spark.createDataFrame([(s, STARTS[s]) for s in sites], "site_id string, start_url string").write.parquet(str(tmp_path / name))
    call = lambda name: cli.main(["crawl", "--web", str(tmp_path / "web"), "--starts", str(tmp_path / name), "--out", str(tmp_path / f"out-{name}"), "--only", "health", "--format", "markdown", "--fail-on", "error", "--exclude", "/p"])
    assert call("one") in (0, 1) and call("two") == 3
    (made,) = (tmp_path / "out-two" / "site=plain").glob("*.txt")
    assert "Pages crawled: 2" in made.read_text() and not list((tmp_path / "out-two").glob("site=gone"))
